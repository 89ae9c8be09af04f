from cohortloom.functions.scalars import (  # noqa: F401
    above_median,
    gaussian_kernel,
    log2_offset,
    nan_to_null,
    number_of,
    order_key,
    parse_measure,
)
