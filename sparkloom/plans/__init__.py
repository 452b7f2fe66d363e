"""sparkloom.plans."""
