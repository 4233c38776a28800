"""Where the given tables are."""

DATA = "/root/testdata/sf0.001"
