"""The dialect's front end: text to clauses, clauses to DataFrames."""
