"""Rental analytics as Spark jobs: operators, table views and a catalogue of business queries."""
