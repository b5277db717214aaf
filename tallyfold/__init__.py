"""Tallyfold: lead analytics and entity resolution as lazy Spark plans."""
