from cohortloom.sources.cohort import (  # noqa: F401
    load_cohort,
    parse_text_table,
    read_cohort,
    read_results,
    write_datasets,
    write_results,
    write_table,
)
