"""lectern: catalog analytics on Spark, declared as DataFrame plans."""
