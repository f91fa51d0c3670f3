"""Where points come from and where they are kept."""
