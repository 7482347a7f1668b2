"""A database of versioned memory over a shared folder: see ``db.Database``."""
