"""Personal data in texts, in DataFrame operations only.

Regular expressions propose spans; validators confirm them (address parts, Luhn, digit counts,
mod-97); an account number has the length of its country, where that is known, and no letter
or digit before or after it; words close by raise the score of a span. Every span of the four basic kinds that its
validator confirms is reported; a span of a further kind needs a score of `LEAST_SCORE`.

The patterns are possessive and start only where no earlier start could match as well, so a
text is searched in linear time and without deep recursion, whatever runs of characters it
has. They match what the plain patterns beside them match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

LEAST_SCORE = 0.5
CONTEXT_BONUS = 0.3
CONTEXT_BEFORE, CONTEXT_AFTER = 40, 20

_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_LOCAL = "[A-Za-z0-9._%+-]"

# Lengths of account numbers and the countries that use them.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _account_pattern() -> str:
    """Groups of four, or of what remains, after the country; other countries may have any length."""
    known = []
    for length, countries in ACCOUNT_LENGTHS.items():
        fours, rest = divmod(length - 4, 4)
        last = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
        known.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}{last}")
    other = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
    return "(?:" + "|".join([*known, other]) + ")"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a character without which nothing matches
    score: float
    context: str  # words that raise the score, tested on lower-case text


KINDS = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|write"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, "ip|host|server|address"),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.8, "card|visa|credit|payment"),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.6, "phone|call|tel|mobile"),
    Kind("iban", "(?=[A-Z]{2}[0-9]{2})" + _account_pattern(), "", 0.7, "iban|account|bank"),
    Kind("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", 0.3, "ssn|social security"),
)
BASE_KINDS = tuple(kind.name for kind in KINDS[:4])
_SPANS = "array<struct<start:int,kind_no:int,end:int,score:double>>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _mod_97(match: Column) -> Column:
    """Whether an account number's check digits are right."""
    compact = F.regexp_replace(match, " ", "")
    turned = F.concat(F.substring(compact, 5, 34), F.substring(compact, 1, 4))
    values = F.split(turned, "")
    rest = F.aggregate(values, F.lit(0), lambda r, c: F.when(
        c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))
    return F.length(compact).between(15, 34) & (rest == 1)


_CONFIRMS = {
    "email": lambda match: F.lit(True),
    "ip": lambda match: match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda match: F.length(_digits(match)).between(12, 19) & F.call_function("luhn_check", _digits(match)),
    "phone": lambda match: F.length(_digits(match)).between(9, 15),
    "iban": _mod_97,
    "ssn": lambda match: ~match.rlike("^(?:000|666|9)|-00-|-0000$"),
}


def _spans_of(kind: Kind, number: int, text: Column, gaps: Column, matches: Column) -> Column:
    """The confirmed matches with their places, which follow from the lengths of the gaps between them."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))
    confirms = _CONFIRMS[kind.name]

    def add(so_far: Column, pair: Column) -> Column:
        start = so_far["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        first = F.greatest(start - CONTEXT_BEFORE, F.lit(0))
        around = F.lower(F.substring(text, first + 1, end + CONTEXT_AFTER - first))
        score = F.lit(kind.score) + F.when(around.rlike(kind.context), CONTEXT_BONUS).otherwise(0.0)
        span = F.struct(start.alias("start"), F.lit(number).alias("kind_no"), end.alias("end"),
                        F.least(score, F.lit(1.0)).alias("score"))
        kept = confirms(pair["match"])
        if kind.name not in BASE_KINDS:
            kept = kept & (score >= LEAST_SCORE)
        if kind.name == "iban":
            beside = F.concat(F.substring(text, start, F.when(start > 0, 1).otherwise(0)), F.substring(text, end + 1, F.lit(1)))
            kept = kept & ~beside.rlike("[A-Z0-9]")
        return F.struct(end.alias("at"), F.when(kept, F.array_append(so_far["spans"], span)).otherwise(so_far["spans"])
                        .alias("spans"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    return F.when(F.size(matches) > 0, F.aggregate(pairs, begin, add)["spans"]).otherwise(F.array().cast(_SPANS))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` as a struct `row`, and their `spans`, an array of (start, end, kind, score).

    Places count code points, the end is exclusive; spans are sorted by start, then in the order
    of `KINDS`, and those of different kinds may overlap. Null and empty texts have none.
    Repeated rows and rows with nulls stay as they are, whatever the names of their columns.
    """
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    for kind in KINDS:
        matches = F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))
        if kind.needs:
            matches = F.when(F.contains("text", F.lit(kind.needs)), matches).otherwise(none)
        rows = rows.withColumn(f"m_{kind.name}", matches)
    for kind in KINDS:
        found = F.size(f"m_{kind.name}") > 0
        rows = rows.withColumn(f"g_{kind.name}", F.when(found, F.split("text", kind.pattern, -1)).otherwise(none))
    for number, kind in enumerate(KINDS):
        made = _spans_of(kind, number, F.col("text"), F.col(f"g_{kind.name}"), F.col(f"m_{kind.name}"))
        rows = rows.withColumn(f"s_{kind.name}", made)
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    merged = F.array_sort(F.concat(*[F.col(f"s_{kind.name}") for kind in KINDS]))
    return rows.select("row", F.transform(merged, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind_no"]).alias("kind"),
        s["score"].alias("score"))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span of `text` replaced by its kind, as `[EMAIL]`; overlapping spans become
    one of the first's kind. `n_chars`, if there, follows where a text changed. Texts without
    spans, null ones too, stay as they are."""
    begin = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def merge(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"), last["kind"].alias("kind"))
        fresh = F.struct(span["start"].alias("start"), span["end"].alias("end"), span["kind"].alias("kind"))
        overlaps = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] > span["start"])
        return F.when(overlaps, F.array_append(F.slice(done, 1, F.size(done) - 1), wider)).otherwise(F.array_append(done, fresh))

    text = F.col("row.text")
    rows = find_pii(docs).withColumn("merged", F.when(F.size("spans") > 0, F.aggregate("spans", begin, merge)).otherwise(begin))
    before = F.transform("merged", lambda span, i: F.struct(
        F.when(i == 0, 0).otherwise(F.get("merged", i - 1)["end"]).alias("start"), span.alias("span")))
    parts = F.transform(before, lambda p: F.concat(
        F.substring(text, p["start"] + 1, p["span"]["start"] - p["start"]), F.lit("["), F.upper(p["span"]["kind"]), F.lit("]")))
    rest = F.substring(text, F.element_at("merged", -1)["end"] + 1, F.length(text))
    changed = F.size("merged") > 0
    rows = rows.select("row", "merged", F.when(changed, F.concat(F.array_join(parts, ""), rest)).otherwise(text).alias("redacted"))
    values = {"text": F.col("redacted"), "n_chars": F.when(changed, F.length("redacted")).otherwise(
        F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*[values[c].alias(c) if values.get(c) is not None else F.col(f"row.`{c}`") for c in docs.columns])


def _digest_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of `documents`."""
    found = find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_count(kind) for kind in BASE_KINDS]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(_digest_text(base), 256).alias("base_sha256"),
                        _digest_text(F.col("spans")).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


# Plain patterns, places by sums over the pieces between the matches.
_ORACLE = r"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
kinds(no, kind) as (values (0, 'email'), (1, 'ip'), (2, 'card'), (3, 'phone'), (4, 'iban'), (5, 'ssn')),
found as (
    select doc_id, t, no, kind, m, g from (
        select doc_id, t, no, kind,
            case no when 0 then regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')
                when 1 then regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)')
                when 2 then regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+')
                when 3 then regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]')
                when 4 then regexp_extract_all(t, 'ACCOUNT')
                else regexp_extract_all(t, '[0-9]{3}-[0-9]{2}-[0-9]{4}') end as m,
            case no when 0 then regexp_split_to_array(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')
                when 1 then regexp_split_to_array(t, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)')
                when 2 then regexp_split_to_array(t, '[0-9](?:[\x20-]?[0-9])+')
                when 3 then regexp_split_to_array(t, '\+[0-9][\x20().0-9-]+[0-9]')
                when 4 then regexp_split_to_array(t, 'ACCOUNT')
                else regexp_split_to_array(t, '[0-9]{3}-[0-9]{2}-[0-9]{4}') end as g
        from texts, kinds)
    where len(m) > 0),
placed as (
    select doc_id, t, no, kind, m[i] as s,
        cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint) as b
    from (select *, unnest(range(1, len(m) + 1)) as i from found)),
checked as (
    select *, b + length(s) as e, regexp_replace(s, '[^0-9]', '', 'g') as d, replace(s, ' ', '') as c,
        lower(substring(t, greatest(b - 40, 0) + 1, b + length(s) + 20 - greatest(b - 40, 0))) as around
    from placed),
confirmed as (
    select doc_id, no, kind, b, e from checked
    where case no when 0 then true
        when 1 then list_bool_and(list_transform(string_split(s, '.'), lambda x: length(ltrim(x, '0')) <= 3 and cast('0' || right(ltrim(x, '0'), 3) as int) <= 255))
        when 2 then length(d) between 12 and 19 and list_sum(list_transform(range(1, length(d) + 1), lambda i:
            case when i % 2 = 1 then cast(d[length(d) + 1 - i] as int)
                else (2 * cast(d[length(d) + 1 - i] as int)) // 10 + (2 * cast(d[length(d) + 1 - i] as int)) % 10 end)) % 10 = 0
        when 3 then length(d) between 9 and 15
        when 4 then length(c) between 15 and 34
            and not regexp_matches(case when b > 0 then substring(t, b, 1) else '' end || substring(t, b + length(s) + 1, 1), '[A-Z0-9]')
            and list_reduce(list_prepend(0, list_transform(string_split(c[5:] || c[1:4], ''), lambda x:
            case when x between '0' and '9' then ascii(x) - 48 else ascii(x) - 55 end)), lambda r, v: case when v < 10 then (r * 10 + v) % 97 else (r * 100 + v) % 97 end) = 1
        else not regexp_matches(s, '^(?:000|666|9)|-00-|-0000$') and regexp_matches(around, 'ssn|social security') end),
digests as (
    select doc_id, count(*) filter (no = 0) as n_email, count(*) filter (no = 1) as n_ip, count(*) filter (no = 2) as n_card,
        count(*) filter (no = 3) as n_phone,
        sha256(coalesce(string_agg(kind || ':' || b || ':' || e, ',' order by b, no) filter (no < 4), '')) as base_sha256,
        string_agg(kind || ':' || b || ':' || e, ',' order by b, no) as spans
    from confirmed group by doc_id)
select d.doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card,
    coalesce(n_phone, 0) as n_phone, coalesce(base_sha256, sha256('')) as base_sha256, coalesce(spans, '') as spans
from documents d left join digests using (doc_id)
""".replace("ACCOUNT", _account_pattern())

QUERIES = {"op1_pii": op1_pii}
ORACLES = {"op1_pii": _ORACLE}
