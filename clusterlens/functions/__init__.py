from clusterlens.functions.scalars import (
    as_int_text,
    contains_any,
    dotted_part,
    is_plain_number,
    last_part,
    lenient_bigint,
    lenient_double,
    msg,
    path_get,
    pct_dev,
    status_mark,
    strict_int,
    thousands,
)

__all__ = [
    "as_int_text",
    "contains_any",
    "dotted_part",
    "is_plain_number",
    "last_part",
    "lenient_bigint",
    "lenient_double",
    "msg",
    "path_get",
    "pct_dev",
    "status_mark",
    "strict_int",
    "thousands",
]
