"""weirflow: transaction change capture and reconciliation, expressed as Spark plans."""
