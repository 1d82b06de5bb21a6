"""Spark jobs that prepare laser-microdissection collections from sets of annotated slides."""
