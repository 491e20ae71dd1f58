"""Folioscope: bibliographic analytics and corpus operators on PySpark DataFrames."""
