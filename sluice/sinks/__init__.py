"""Writers: silver, rejected zone, append-only audit tables, snapshots."""
