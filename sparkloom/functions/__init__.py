"""sparkloom.functions."""
