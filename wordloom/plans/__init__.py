"""Jobs over whole data sets: loading sources, and the model of the TPC-H-like test data."""
