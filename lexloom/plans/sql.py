"""DuckDB SQL fragments that mirror the column expressions, for texts without special tokens."""

from __future__ import annotations

from lexloom.config import SplitConfig
from lexloom.functions.words import NO_BLANK_AFTER, NO_BLANK_BEFORE

PIECES = r" +|\n+|\p{Nd}|[^\p{L}\p{N}]|[\p{L}\p{Nl}\p{No}]+"
SPACES = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def _run(token: str, name: str, n: str) -> str:
    pairs = f"({n} // 2)"
    fours = f"greatest(({pairs} + 1) // 2 - 1, 0)"
    rest = f"({pairs} - 2 * {fours})"
    of = lambda k: quoted(f"<|{k}<-{name}->|>")
    middle = f"CASE {rest} WHEN 2 THEN [{of(4)}] WHEN 1 THEN [{of(2)}] ELSE []::VARCHAR[] END"
    last = f"CASE WHEN {n} % 2 = 1 THEN [{quoted(token)}] ELSE []::VARCHAR[] END"
    return f"list_concat(list_concat(list_transform(range({fours}), lambda q: {of(4)}), {middle}), {last})"


def words(source: str, keys: str, text: str) -> str:
    """A query of keys and w, the list of words."""
    after = lambda x: f"coalesce(contains({quoted(NO_BLANK_AFTER)}, left({x}, 1)), false)"
    before = lambda x: f"coalesce(contains({quoted(NO_BLANK_BEFORE)}, left({x}, 1)), false)"
    blank = f"CASE WHEN length(x) > 1 OR i = 1 OR i = len(p) OR {after('p[i-1]')} OR {before('p[i+1]')} THEN {_run('<|ws|>', 'ws', 'length(x)')} ELSE []::VARCHAR[] END"
    line = _run("<|\n|>", "\n", "length(x)")
    join = f"p[i+1] IS NOT NULL AND NOT starts_with(p[i+1], ' ') AND NOT starts_with(p[i+1], chr(10)) AND NOT {after('x')} AND NOT {before('p[i+1]')}"
    one = f"CASE WHEN starts_with(x, ' ') THEN {blank} WHEN starts_with(x, chr(10)) THEN {line} WHEN {join} THEN [x, '<|no_ws|>'] ELSE [x] END"
    return f"SELECT {keys}, flatten(list_transform(p, lambda x, i: {one})) AS w FROM (SELECT {keys}, regexp_extract_all({text}, '{PIECES}') AS p FROM {source})"


def md5_mod(text: str, modulus: int) -> str:
    return f"(('0x' || md5({text}))::UHUGEINT % {modulus})::INTEGER"


def triple_ids(word: str) -> str:
    h = f"hex(encode(' ' || {word} || ' '))"
    part = lambda a: f"substr({h}, i * 2 + {a}, 2)"
    return f"list_distinct(list_transform(range(length({h}) // 2 - 2), lambda i: ('0x' || {part(5)} || {part(3)} || {part(1)})::INTEGER))"


def word_slots(word: str, c: SplitConfig) -> str:
    own = [md5_mod(f"{word} || '_{i}'", c.vocab_size) for i in range(c.slots - c.shared_slots)]
    return "[" + ", ".join(own + [md5_mod(f"lower({word}) || '_lower_{i}'", c.vocab_size) for i in range(c.shared_slots)]) + "]"


def triple_rows(source: str, column: str, c: SplitConfig, attempts: int = 8) -> str:
    """A query of `column` and slots, ascending, before any sharing."""
    sql = f"SELECT {column}, []::INTEGER[] AS acc FROM {source}"
    for k in range(c.slots):
        tries = f"list_transform(range({attempts}), lambda j: {md5_mod(f'{column}::VARCHAR || chr(95) || {k} || chr(95) || j', c.vocab_size)})"
        sql = f"SELECT {column}, list_append(acc, list_filter({tries}, lambda v: NOT list_contains(acc, v))[1]) AS acc FROM ({sql})"
    return f"SELECT {column}, list_sort(acc) AS slots FROM ({sql})"
