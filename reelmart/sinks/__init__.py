"""Writers: CSV folders and catalog tables."""
