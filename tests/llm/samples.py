"""Where the tests' tables are."""

DATA = "/root/testdata/sf0.001"
