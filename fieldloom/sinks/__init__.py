"""Writers of datasets, reports and ledgers."""
