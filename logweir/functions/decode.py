"""Strict typed decode of JSON log events, in native expressions only.

``from_json`` with the event schema is too lenient (it turns numbers into text, accepts trailing
text and matches keys by exact case), so the payload is read as a map of variants, which keeps the
document order and repeated keys, and the type rules are checked on the variants.

The expressions are SQL text, since a streaming job builds them anew for every micro-batch and a
column object per operator would cost a second each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.schema import EVENT_COLUMNS

OK = "ok"
ERROR_PARSE = "error_parse"
ERROR_LIMIT = "error_limit"

TEXT_KEYS = ("event_id", "source", "level", "message")
TIME_KEYS = ("received_at", "event_time")

# The standard JSON grammar: Spark's reader allows single quotes and NaN unless told otherwise.
# The parser's own limits would refuse valid documents, so they are lifted; nesting is bounded by
# the thread's stack, and what is nested deeper, or has a longer key, is told apart as ERROR_LIMIT.
MAX_DEPTH = 3_000
MAX_KEY = 50_000
STRICT_JSON = (
    "map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false', "
    f"'maxNestingDepth', '{MAX_DEPTH}', 'maxNumLen', '{2**31 - 1}', 'maxStringLen', '{2**31 - 1}')"
)

RFC3339 = (
    r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?"
    r"(Z|[+-]([01]\d|2[0-3]):[0-5]\d)\z"
)


def rfc3339_sql(text: str) -> str:
    """Timestamp of an RFC 3339 text, NULL when it is not one. Nanoseconds are cut to micros.

    Offsets up to 23:59 are legal, more than a zone id allows: the text is read as UTC and moved.
    """
    minutes = f"(try_cast(substr({text}, -5, 2) AS INT) * 60 + try_cast(substr({text}, -2, 2) AS INT))"
    return f"""CASE WHEN {text} RLIKE r'{RFC3339}' THEN
        CASE WHEN endswith({text}, 'Z') THEN try_cast({text} AS TIMESTAMP)
        ELSE timestamp_micros(
          unix_micros(try_cast(concat(substr({text}, 1, length({text}) - 6), 'Z') AS TIMESTAMP))
          - CASE substr({text}, -6, 1) WHEN '-' THEN -60000000L ELSE 60000000L END * {minutes}) END END"""


def parse_rfc3339(column: str) -> Column:
    return F.expr(rfc3339_sql(column))


def objects_sql(text: str) -> str:
    """The text read as the elements of a JSON array of objects; NULL when malformed.

    A single well-formed object gives one element, blank text none, ``{},{}`` two.
    Text that closes the array itself must be ruled out with :func:`closes_early_sql`.
    """
    return f"from_json(concat('[', {text}, ']'), 'array<map<string,variant>>', {STRICT_JSON})"


def one_value_sql(text: str) -> str:
    """True when the text is exactly one JSON value, NULL or false otherwise."""
    as_member = f"from_json(concat('{{\"d\":', {text}, '}}'), 'map<string,variant>', {STRICT_JSON})"
    as_element = f"from_json(concat('[', {text}, ']'), 'array<variant>', {STRICT_JSON})"
    return f"(map_keys({as_member}) = array('d') AND size({as_element}) = 1)"


def beyond_limits_sql(text: str) -> str:
    """Whether a text that does not parse may be valid JSON beyond what the parser can hold."""
    openers = f"length({text}) - length(translate({text}, '[{{', ''))"
    return (f"(octet_length({text}) > {MAX_DEPTH} AND ({openers} >= {MAX_DEPTH} "
            f"OR {text} RLIKE r'\"[^\"]{{{MAX_KEY},}}\"'))")


def closes_early_sql(text: str) -> str:
    """True when the first object is followed by a ``]`` of the text's own, as in ``{} ] x``.

    Only text with ``}`` before ``]`` can do so; that text is read once more inside an object,
    where the stray bracket is malformed.
    """
    inside = f"concat('{{\"d\":', {text}, '}}')"
    return (
        f"CASE WHEN contains({text}, ']') AND {text} RLIKE r'\\}}\\s*\\]' "
        f"THEN from_json({inside}, 'map<string,variant>', {STRICT_JSON}) IS NULL ELSE false END"
    )


def text_sql(value: str) -> str:
    """Text of a variant string, NULL for every other kind: only strings cast to binary."""
    return f"CAST(try_variant_get({value}, '$', 'binary') AS STRING)"


def _quoted(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{name}'" for name in names)


# U+017F (long s) is a case variant of s.
FOLDED_KEYS = "transform(_raw_keys, k -> translate(lower(k), 'ſ', 's'))"

# Whether one entry of a document with repeated keys has the type its key asks for.
ENTRY_OK = f"""CASE WHEN is_variant_null(e._values) THEN true
  WHEN e._keys IN ({_quoted(TEXT_KEYS)}) THEN {text_sql('e._values')} IS NOT NULL
  WHEN e._keys IN ({_quoted(TIME_KEYS)}) THEN {rfc3339_sql(text_sql('e._values'))} IS NOT NULL
  WHEN e._keys = 'pii_redacted' THEN schema_of_variant(e._values) = 'BOOLEAN'
  ELSE true END"""


def _occurrence(name: str) -> str:
    """The deciding value of a key when several keys of the document fold to one name.

    The last one counts; JSON null leaves an earlier scalar as it was, but replaces metadata.
    """
    counts = "" if name == "metadata" else " AND NOT is_variant_null(e._values)"
    return f"try_element_at(filter(arrays_zip(_keys, _values), e -> e._keys = '{name}'{counts}), -1)._values"


def _value(place: int, name: str) -> str:
    return f"""CASE WHEN _repeats THEN try_element_at(_decided, {place})
      ELSE try_element_at(_values, CAST(nullif(array_position(_keys, '{name}'), 0) AS INT)) END AS _{name}"""


def parse_events(df: DataFrame, col: str = "raw_event", missing_time: str | None = None) -> DataFrame:
    """Decode column ``col`` into the event columns and ``parse_status``.

    Rows that break a rule keep their other columns, get NULL event columns and ``error_parse``, or
    ``error_limit`` where the text may be valid but is nested too deep, or has too long a key, to read.
    A missing event time is NULL, or year 1 with ``missing_time="zero"``.
    """
    if missing_time not in (None, "zero"):
        raise ValueError("missing_time must be None or 'zero'")
    if col in EVENT_COLUMNS:
        raise ValueError(f"{col} would be overwritten; rename the payload column")
    kept = [f"`{c}`" for c in df.columns if c not in EVENT_COLUMNS and c != "parse_status"]
    payload = f"`{col}`"
    known = " + ".join(f"CAST(array_contains(_raw_keys, '{name}') AS INT)" for name in EVENT_COLUMNS)
    scalars = TEXT_KEYS + TIME_KEYS

    # Each layer names its results, so no expensive expression is written out twice in the plan.
    layers = [
        [
            f"{objects_sql(payload)} AS _docs",
            f"{closes_early_sql(payload)} AS _stray",
            # A JSON null document is an empty event.
            rf"{payload} RLIKE r'^[ \t\r\n]*null[ \t\r\n]*\z' AS _null",
        ],
        ["_null", "CASE WHEN size(_docs) = 1 AND NOT _stray THEN try_element_at(_docs, 1) END AS _object"],
        ["_null", "map_keys(_object) AS _raw_keys", "map_values(_object) AS _values"],
        # All keys are distinct event keys in exact case: the usual document needs no folding.
        ["_null", "_raw_keys", "_values", f"size(_raw_keys) = {known} AS _plain"],
        ["_null", "_values", "_plain", f"CASE WHEN _plain THEN _raw_keys ELSE {FOLDED_KEYS} END AS _keys"],
        ["_null", "_values", "_keys", "NOT _plain AND size(array_distinct(_keys)) <> size(_keys) AS _repeats"],
        # Repeated keys are rare: only their rows search all entries, and check each of them.
        [
            "_null", "_values", "_keys", "_repeats",
            f"CASE WHEN _repeats THEN array({', '.join(map(_occurrence, EVENT_COLUMNS))}) END AS _decided",
            f"CASE WHEN _repeats THEN forall(arrays_zip(_keys, _values), e -> {ENTRY_OK}) "
            "ELSE _keys IS NOT NULL END AS _entries_ok",
        ],
        ["_null", "_entries_ok", *[_value(n, name) for n, name in enumerate(EVENT_COLUMNS, 1)]],
        [
            "_null", "_entries_ok", "_metadata", "_pii_redacted",
            *[f"{text_sql(f'_{n}')} AS _{n}_text" for n in scalars],
            *[f"(_{n} IS NULL OR is_variant_null(_{n})) AS _{n}_missing" for n in scalars],
        ],
        [
            "_null", "_entries_ok", "_metadata", "_pii_redacted",
            *[f"_{n}_text" for n in TEXT_KEYS], *[f"_{n}_missing" for n in scalars],
            *[f"{rfc3339_sql(f'_{n}_text')} AS _{n}_time" for n in TIME_KEYS],
        ],
    ]
    for layer in layers:
        df = df.selectExpr(*kept, *layer)

    fields_ok = " AND ".join(
        [f"(_{n}_missing OR _{n}_text IS NOT NULL)" for n in TEXT_KEYS]
        + [f"(_{n}_missing OR _{n}_time IS NOT NULL)" for n in TIME_KEYS]
        + ["(_pii_redacted IS NULL OR is_variant_null(_pii_redacted) OR schema_of_variant(_pii_redacted) = 'BOOLEAN')"]
    )
    # The verdict passes through a one-element explode: all event columns depend on it, and no
    # filter on them moves below a generator, where it would repeat the decode many times over.
    judged = df.selectExpr("*", f"explode(array(coalesce(_null OR (_entries_ok AND {fields_ok}), false))) AS _ok")

    zero = "TIMESTAMP '0001-01-01 00:00:00Z'"
    results = {name: f"coalesce(_{name}_text, '')" for name in TEXT_KEYS} | {
        "received_at": "_received_at_time",
        "event_time": f"coalesce(_event_time_time, {zero})" if missing_time else "_event_time_time",
        "metadata": "to_json(_metadata)",
        "pii_redacted": "coalesce(try_variant_get(_pii_redacted, '$', 'boolean'), false)",
    }
    return judged.selectExpr(
        *kept,
        *[f"CASE WHEN _ok THEN {results[name]} END AS {name}" for name in EVENT_COLUMNS],
        f"CASE WHEN _ok THEN '{OK}' WHEN {beyond_limits_sql(payload)} THEN '{ERROR_LIMIT}' "
        f"ELSE '{ERROR_PARSE}' END AS parse_status",
    )
