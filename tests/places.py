"""Where the tests' tables are, and the access point of their ordinary rows."""

DATA = "/root/testdata/sf0.001"
AP = "02:10:00:00:00:01"
