"""DataFrame operators: profile, label, select, impute, scale, split, evaluate."""
