"""sparkloom.streaming."""
