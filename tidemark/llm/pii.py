r"""Personal data in texts, in DataFrame operations only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for bank accounts), and words nearby
before and after raise the score. Secrets without a form of their own are long runs of letters and digits that such words
must stand beside. A span's place comes from the lengths of what lies between matches: splitting a text
by a pattern gives the gaps, extracting gives the matches, and the running total of both gives the starts, in code points.

Patterns are written so that each takes time in proportion to the text: a match can only start where a run of its
characters does, or where the last match ended, and runs that need no second try are possessive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import private


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a cheap test that every text with a match passes
    score: float
    context: str
    base: bool = True


#: Kinds in order, their patterns, scores and context words.
KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"mail|contact|write to|correo|courriel|kontakt"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, r"\bip\b|address|host|server|adresse|dirección"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]", 0.7, r"card|visa|credit|payment|tarjeta|carte|karte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, r"phone|call|tel|fax|mobile|teléfono|téléphone|telefon"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.8, r"iban|account|bank|konto|cuenta|compte", base=False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", 0.4, r"ssn|social|security|taxpayer", base=False),
    Kind("key", r"A[KS]IA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abp]-[A-Za-z0-9-]{10}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", r"A[KS]IA|gh[opsu]_|glpat-|xox[abp]-|PRIVATE KEY", 0.8, r"key|token|secret", base=False),
    Kind("secret", r"(?<![A-Za-z0-9+/_])[A-Za-z0-9+/_]{20,}+", r"(?iu)token|secret|passw|credential|bearer|api.?key|access.?key", 0.3, r"token|secret|passw|credential|bearer|api.?key|access.?key", base=False),
]
BONUS = 0.2
#: An added kind needs this score, its own or with context; base kinds stay at any score.
LEAST = 0.5
NEAR = 40


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Of a string of digits; each second digit from the right counts double, less 9 above 9."""
    at = F.split(F.reverse(digits), "")
    worth = F.transform(F.filter(at, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Of letters and digits: the first four go last, letters count from 10, and the number leaves 1 over 97."""
    turned = F.filter(F.split(F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4)), ""), lambda c: c != "")
    digit = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(turned, F.lit(0), lambda a, c: F.when(digit(c) < 10, (a * 10 + digit(c)) % 97).otherwise((a * 100 + digit(c)) % 97)) == 1


def _valid(kind: str, text: Column) -> Column:
    n = F.length(_digits(text))
    if kind == "ip":
        small = lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.right(p, F.lit(3)).try_cast("int") <= 255)
        return F.forall(F.split(text, r"\."), small)
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(_digits(text))).otherwise(False)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    if kind == "iban":
        code = F.replace(text, F.lit(" "), F.lit(""))
        return F.when(F.length(code).between(15, 34), mod97(code)).otherwise(False)
    if kind == "secret":
        return (n >= 3) & text.rlike("[A-Za-z]")
    return F.lit(True)


_BLOCK = 128


def _running(lengths: Column) -> Column:
    """The total before each of an array of numbers.

    A fold over the whole array would copy what it has at each step. So the totals of blocks are folded, which are few, and
    then each block by itself.
    """
    blocks = F.sequence(F.lit(0), F.ceil(F.size(lengths) / _BLOCK).cast("int") - 1)
    block = lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK))
    add = lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)
    sums = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda a, x: a + x))
    before = F.aggregate(sums, F.array(F.lit(0)), add)
    inside = F.zip_with(blocks, F.slice(before, F.lit(1), F.size(sums)), lambda b, start: F.slice(F.aggregate(block(b), F.array(start), add), F.lit(1), F.size(block(b))))
    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).otherwise(F.flatten(inside))


_CUT = "array<struct<gap:int,before:string,match:string,after:string>>"


def _cut(kind: Kind, text: Column) -> Column:
    """_CUT: the matches of a kind with how many characters lie before each, and NEAR of those on both sides; empty for most texts at the price of one test."""
    gaps, matches = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    both = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(NEAR)).alias("before"), m.alias("match")))
    after = F.transform(F.slice(gaps, 2, F.size(gaps)), lambda g: F.left(g, F.lit(NEAR)))
    cut = F.zip_with(both, after, lambda x, a: F.struct(x["gap"].alias("gap"), x["before"].alias("before"), x["match"].alias("match"), a.alias("after")))
    hint = F.contains(text, F.lit(kind.hint)) if kind.hint == "@" else text.rlike(kind.hint)
    return F.when(hint, F.filter(cut, lambda x: x["match"].isNotNull())).otherwise(F.array().cast(_CUT))


def _scored(kind: Kind, rank: int, cut: Column, before: Column) -> Column:
    """array<struct<start, rank, end, kind, text, score>> of the valid matches of a kind."""

    def scored(x):
        near = F.lower(F.concat_ws(" ", x["before"], x["after"]))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), BONUS).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), (x["start"] + F.length(x["match"])).alias("end"), F.lit(kind.name).alias("kind"), x["match"].alias("text"), F.round(score, 2).alias("score"))

    placed = F.zip_with(cut, before, lambda x, at: F.struct((at + x["gap"]).alias("start"), x["before"].alias("before"), x["match"].alias("match"), x["after"].alias("after")))
    valid = F.filter(placed, lambda x: _valid(kind.name, x["match"]))
    return F.filter(F.transform(valid, scored), lambda x: F.lit(kind.base) | (x["score"] >= LEAST))


def _with_spans(df: DataFrame, text: Column, out: str) -> DataFrame:
    """df with a column out: all spans of text, by start and then kind as listed.

    Each step is a column of its own, which the steps within arrays then read: what stands inside a function of array
    elements is worked out again for each element. df must have no column that begins with out.
    """
    own = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]
    n = range(len(KINDS))
    df = df.select(*own, *[_cut(k, text).alias(f"{out}_cut{i}") for i, k in enumerate(KINDS)])
    lengths = [F.transform(f"{out}_cut{i}", lambda x: x["gap"] + F.length(x["match"])).alias(f"{out}_length{i}") for i in n]
    df = df.select(*own, *[f"{out}_cut{i}" for i in n], *lengths)
    df = df.select(*own, *[f"{out}_cut{i}" for i in n], *[_running(F.col(f"{out}_length{i}")).alias(f"{out}_at{i}") for i in n])
    spans = [_scored(k, i, F.col(f"{out}_cut{i}"), F.col(f"{out}_at{i}")) for i, k in enumerate(KINDS)]
    return df.select(*own, F.array_sort(F.concat(*spans)).alias(out))


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans: array of start, rank, end, kind, text, score, by start and then kind as listed.

    Places are code points, ends exclusive. Words of context count in NEAR characters before and after a match, as far as
    no other match of the kind stands there. Null and empty texts have no spans; spans of different kinds may overlap;
    repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return _with_spans(own, F.col("text"), "spans").select("doc_id", "spans")


def mask_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs, with each span of text replaced by its kind in angle brackets; of overlapping spans the first counts."""
    spans, whole = private(docs.columns), F.coalesce(F.col(text), F.lit(""))
    kept = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), lambda s, x: F.when(x["start"] < s["at"], s).otherwise(
        F.struct(x["end"].alias("at"), F.concat(s["out"], F.substring(whole, s["at"] + 1, x["start"] - s["at"]), F.lit("<"), x["kind"], F.lit(">")).alias("out"))
    ))
    found = _with_spans(docs, whole, spans).withColumn(f"{spans}end", kept)
    masked = F.concat(F.col(f"{spans}end")["out"], F.substring(whole, F.col(f"{spans}end")["at"] + 1, F.length(whole)))
    return found.select(*[F.when(F.col(text).isNotNull(), masked).alias(text) if c == text else F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans, their scores in the same order, and their number: of find_pii()'s result."""
    base = [k.name for k in KINDS if k.base]
    of_base = F.filter("spans", lambda x: x["kind"].isin(base))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    scores = F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",")
    return found.select("doc_id", *map(count, base), F.sha2(_joined(of_base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), scores.alias("scores"), F.size("spans").cast("long").alias("n_spans"))


SQL = r"""
with k(kind, rank, pattern, worth, near) as (values
  ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+', 0.9::double, 'mail|contact|write to|correo|courriel|kontakt'),
  ('ip', 1, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)', 0.6, '\bip\b|address|host|server|adresse|dirección'),
  ('card', 2, '[0-9]([\x20-]?[0-9])+', 0.7, 'card|visa|credit|payment|tarjeta|carte|karte'),
  ('phone', 3, '\+[0-9][\x20().0-9-]+[0-9]', 0.6, 'phone|call|tel|fax|mobile|teléfono|téléphone|telefon'),
  ('iban', 4, '[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}', 0.8, 'iban|account|bank|konto|cuenta|compte'),
  ('ssn', 5, '[0-9]{3}-[0-9]{2}-[0-9]{4}', 0.4, 'ssn|social|security|taxpayer'),
  ('key', 6, 'A[KS]IA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abp]-[A-Za-z0-9-]{10}|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----', 0.8, 'key|token|secret'),
  ('secret', 7, '[A-Za-z0-9+/_]{20,}', 0.3, 'token|secret|passw|credential|bearer|api.?key|access.?key')),
t as (select row_number() over () as rid, doc_id, coalesce(text, '') as s from documents),
m as (select rid, s, k.*, regexp_extract_all(s, pattern) as ms, string_split_regex(s, pattern) as gs from t, k),
e as (select rid, s, kind, rank, worth, near, unnest(ms) as hit, unnest(gs[1:len(ms)]) as gap, unnest(gs[2:len(ms) + 1]) as nxt, unnest(range(len(ms))) as i from m where len(ms) > 0),
p as (select *, (sum(length(gap) + length(hit)) over (partition by rid, rank order by i) - length(hit))::bigint as start, regexp_replace(hit, '[^0-9]', '', 'g') as d,
  round(worth + case when regexp_matches(lower(right(gap, 40) || ' ' || left(nxt, 40)), near) then 0.2::double else 0 end, 2) as score from e),
q as (select *, string_split(reverse(d), '') as back, substr(s, start::bigint, case when start > 0 then 1 else 0 end) as before, substr(s, (start + length(hit) + 1)::bigint, 1) as after,
  replace(hit, ' ', '') as code from p),
v as (select * from q where case kind
  when 'email' then true
  when 'ip' then len([x for x in string_split(hit, '.') if length(ltrim(x, '0')) > 3 or right(x, 3)::int > 255]) = 0
  when 'card' then length(d) between 14 and 19 and list_sum([case when j % 2 = 1 then back[j]::int else (2 * back[j]::int) // 10 + (2 * back[j]::int) % 10 end for j in range(1, length(d) + 1)]) % 10 = 0
  when 'phone' then length(d) between 10 and 15
  when 'iban' then length(code) between 15 and 34 and not regexp_matches(before, '[A-Za-z0-9]') and not regexp_matches(after, '[A-Za-z0-9]') and list_reduce(
    list_prepend(0, [x::int for x in string_split(array_to_string([case when c between '0' and '9' then c else (ascii(c) - 55)::varchar end for c in string_split(substr(code, 5) || left(code, 4), '')], ''), '')]), lambda a, x: (a * 10 + x) % 97) = 1
  when 'key' then true
  when 'secret' then score >= 0.5 and length(d) >= 3 and regexp_matches(hit, '[A-Za-z]')
  else score >= 0.5 and not regexp_matches(before, '[0-9-]') and not regexp_matches(after, '[0-9-]') and not regexp_matches(hit, '^(000|666|9)') and substr(hit, 5, 2) <> '00' and right(hit, 4) <> '0000' end),
g as (select rid, kind, rank, start, kind || ':' || start || ':' || (start + length(hit)) as span, score from v)
select t.doc_id, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip, count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,
  sha256(coalesce(string_agg(span, ',' order by start, rank) filter (rank < 4), '')) as base_sha256, coalesce(string_agg(span, ',' order by start, rank), '') as spans, coalesce(string_agg(score::varchar, ',' order by start, rank), '') as scores, count(g.rid) as n_spans
from t left join g on t.rid = g.rid group by t.rid, t.doc_id
"""
