"""DataFrame operators: validation, normalisation, matching, evidence, snapshots, comparison."""
