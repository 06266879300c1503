"""Where tables and packs come from."""
