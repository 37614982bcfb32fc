"""Reading and writing collections: tables, snapshots and dumps."""
