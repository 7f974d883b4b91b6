"""Panel analytics as Spark jobs: sources, cleaning, joins, rules, profiles, features, labels, models and scenarios."""
