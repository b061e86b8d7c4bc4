"""Where data comes from and goes to: tables, snapshots, the scratch folder."""
