"""Workforce analytics on Spark: companies, employment spells and job postings."""
