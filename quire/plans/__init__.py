"""Translation plans: making them, checking them, and joining them back to their documents."""
