"""Training-data operators: deduplication, decontamination, mixing, quality,
personal data, archives, sketches and token files.

Nothing outside this subpackage imports it. Each ``opNN`` module holds one
general operator; ``queries`` binds them to the driver tables."""
