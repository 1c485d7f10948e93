"""Query plans: corpora over the driver tables, the registry, its SQL twins."""
