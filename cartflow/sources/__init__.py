"""Table specifications, readers, writers and sampling."""
