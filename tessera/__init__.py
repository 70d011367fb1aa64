"""Tessera: Spark operators for cross-sectional time-series panels.

Every operator maps DataFrames to a DataFrame and leaves the physical plan to
Catalyst and AQE.  Nothing here holds a session.  The only jobs run while a plan
is built are size checks that return one number (see ``functions.ranking``) and
those a docstring marks as an action.
"""
