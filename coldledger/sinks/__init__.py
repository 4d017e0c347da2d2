"""Writers: DataFrames -> reports, manifests and catalogue snapshots."""
