"""sparkloom: dependency and quality analytics over relations, as Spark DataFrame jobs."""
