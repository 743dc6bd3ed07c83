"""Learning-programme analytics as Spark DataFrame operators.

Every operator takes a :class:`~cohortlens.sources.tables.Tables` (eleven input DataFrames) and,
where the answer depends on the clock, an explicit ``as_of`` moment.  It returns a lazy DataFrame
at its natural grain for all programmes at once.
"""
