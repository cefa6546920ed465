"""DataFrame operators: scoring, analysis, corpus quality, joins, planning, judging."""
