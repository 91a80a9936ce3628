"""Where the given tables of the smallest size lie."""

SF = "/root/testdata/sf0.001"
