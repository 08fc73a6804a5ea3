from cohortkit.sources.io import (  # noqa: F401
    enrich, load_split, normalise_columns, read_table, select_split, to_sink_names, write_json,
    write_table,
)
