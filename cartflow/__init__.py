"""Basket analytics on PySpark: strict ingest, retail model, KPIs, association rules, recommendations."""
