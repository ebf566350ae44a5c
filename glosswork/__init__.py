"""Review analytics on Spark: clean, code text, select features, fit ensembles, score, explain."""

from glosswork.session import ship_by_value

# Python workers get this package's functions inside the job, so nothing has to be installed on them.
ship_by_value(__name__)
