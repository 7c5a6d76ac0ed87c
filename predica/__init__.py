"""predica: a rule engine on Spark."""
