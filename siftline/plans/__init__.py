"""Jobs made of several operators: preparation, training, tuning, scoring, reports."""
