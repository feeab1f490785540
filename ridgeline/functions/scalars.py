"""Scalar expressions over columns: cleaning, severities, tags, entities, times, sequences, answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions import constants as K


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(table: dict, key: Column) -> Column:
    """Value of ``key`` in a small fixed table, else null."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def clean(x: Column | str) -> Column:
    """Trimmed text, null if blank."""
    return F.nullif(F.trim(_c(x).cast("string")), F.lit(""))


def first_text(*columns: Column | str, default: str | None = None) -> Column:
    """The first value that is not blank (SCL-01)."""
    return F.coalesce(*[clean(c) for c in columns], F.lit(default))


def first_truthy(*columns: Column | str) -> Column:
    """The first value that is neither null, empty nor zero, as text."""
    return F.coalesce(*[F.when(~_c(c).cast("string").isin("", "0", "0.0", "false"), _c(c).cast("string")) for c in columns])


def normalize_token(x: Column | str) -> Column:
    """Lower-cased ASCII letters and digits, all else runs of one underscore, none at the ends (SCL-02)."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(x))), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")


def normalize_token_unicode(x: Column | str) -> Column:
    """The same for letters and digits of all scripts (SCL-03)."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(x))), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def severity_sentinel(x: Column | str) -> Column:
    """Words on the 9/6/4/2 scale, numbers cut to 0..10, else 1 (SCL-04)."""
    t = F.lower(F.trim(F.coalesce(_c(x).cast("string"), F.lit(""))))
    n = t.try_cast("double")
    number = F.when(n.isNotNull() & ~F.isnan(n), F.least(F.greatest(n.cast("int"), F.lit(0)), F.lit(10)))
    return F.coalesce(lookup(K.SENTINEL_SEVERITY, t), number, F.lit(1)).cast("int")


def severity_falcon(x: Column | str) -> Column:
    """Words on the 10/9/6/3/2 scale, else 1 (SCL-05)."""
    return F.coalesce(lookup(K.FALCON_SEVERITY, F.lower(F.trim(_c(x)))), F.lit(1)).cast("int")


def severity_unit(text: Column | str, number: Column | None = None) -> Column:
    """0..1: a number is a percentage, a known word its share, other text 0.5, null 0 (SCL-06)."""
    word = F.when(_c(text).isNull(), 0.0).otherwise(F.coalesce(lookup(K.UNIT_SEVERITY, F.lower(F.trim(_c(text)))), F.lit(0.5)))
    return word if number is None else F.when(number.isNotNull(), F.least(F.greatest(number / 100.0, F.lit(0.0)), F.lit(1.0))).otherwise(word)


def row_text(*columns: Column | str) -> Column:
    """Lower-cased columns joined by blanks, nulls as empty (SCL-10)."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in columns]))


def attack_tags(text: Column) -> Column:
    """Kinds of which any word occurs in the lower-cased text, in the order of telling (SCL-07)."""
    hits = [F.when(_any_in(text, words), F.lit(kind)) for kind, words in K.KIND_WORDS.items()]
    return F.array_compact(F.array(*hits))


def _any_in(text: Column, words: Sequence[str]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def infer_kind(tags: Column, name: Column) -> Column:
    """The first tag, else the name as a token (SCL-09)."""
    return F.when(F.size(tags) > 0, F.element_at(tags, 1)).otherwise(F.coalesce(F.nullif(normalize_token(name), F.lit("")), F.lit("security_alert")))


def matches_attack_kind(kind: Column, action: Column, tags: Column) -> Column:
    """Whether kind, action or a tag is an attack kind (FLT-02)."""
    labels = F.concat(F.array(F.lower(kind), F.lower(action)), F.transform(tags, F.lower))
    return F.arrays_overlap(labels, F.array(*map(F.lit, K.ATTACK_KINDS)))


def parse_ids(x: Column | str) -> Column:
    """Ids of a JSON list, else all UUIDs in the text, distinct (SCL-08)."""
    c = F.coalesce(_c(x), F.lit(""))
    listed = F.filter(F.from_json(c, "array<string>"), lambda v: v.isNotNull() & (v != ""))
    return F.array_distinct(F.when(c.startswith("[") & listed.isNotNull(), listed).otherwise(F.regexp_extract_all(c, F.lit(f"({K.UUID})"), F.lit(1))))


def entity_id(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.lower(value))


def entity_of(item: Column) -> Column:
    """(type, value, id) of a raw entity given as map<string,string>, else null (SCL-12)."""
    kind = F.lower(F.coalesce(item["Type"], F.lit("")))
    out = F.lit(None).cast("struct<type:string,value:string,id:string>")
    for raw, (etype, keys) in K.RAW_ENTITIES.items():
        usable = [F.trim(F.coalesce(item[k], F.lit(""))) for k in keys]
        value = F.left(F.coalesce(*[F.when((v != "") & ~F.lower(v).isin(*K.EMPTY_ENTITY_VALUES), v) for v in usable]), F.lit(500))
        entity = F.struct(F.lit(etype).alias("type"), value.alias("value"), entity_id(F.lit(etype), value).alias("id"))
        out = F.when((kind == raw) & value.isNotNull(), entity).otherwise(out)
    return out


def entities_from_json(payload: Column | str, *fallbacks: tuple[Column | str, str]) -> Column:
    """Distinct entities of a JSON list without references, then of plain columns given with their types (SCL-11)."""
    items = F.coalesce(F.from_json(_c(payload), "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    kept = F.filter(items, lambda m: m.isNotNull() & ~F.coalesce(F.map_contains_key(m, F.lit("$ref")), F.lit(False)))
    plain = [F.when(clean(c).isNotNull(), F.struct(F.lit(t).alias("type"), clean(c).alias("value"), entity_id(F.lit(t), clean(c)).alias("id"))) for c, t in fallbacks]
    every = F.concat(F.transform(kept, entity_of), F.array(*plain).cast("array<struct<type:string,value:string,id:string>>")) if plain else F.transform(kept, entity_of)
    every = F.filter(every, lambda e: e.isNotNull())
    ids = F.transform(every, lambda e: e["id"])
    return F.filter(every, lambda e, i: F.array_position(ids, e["id"]) == i + 1)


def cluster_entities(entity_ids: Column, scope: Column) -> Column:
    """Entities that may link alerts: all but the service that stands for the source itself (SCL-13)."""
    return F.array_except(entity_ids, F.array(F.concat(F.lit("service:"), F.lower(F.trim(F.coalesce(scope, F.lit("")))))))


def parse_time(*columns: Column | str) -> Column:
    """The first column that parses as a timestamp (SCL-14)."""
    return F.coalesce(*[F.coalesce(F.try_to_timestamp(_c(c)), F.try_to_timestamp(F.left(_c(c), F.lit(19)), F.lit("yyyy-MM-dd HH:mm:ss"))) for c in columns])


def epoch_seconds(x: Column | str) -> Column:
    """Seconds of a number or an ISO text (SCL-15)."""
    c = _c(x).cast("string")
    return F.coalesce(c.try_cast("double"), F.unix_micros(F.try_to_timestamp(c)) / 1e6)


def epoch_guess(x: Column | str) -> Column:
    """Timestamp of a number of seconds or, above 10**12, milliseconds; of text by parsing (SCL-16)."""
    v = _c(x).cast("string").try_cast("double")
    return F.coalesce(F.timestamp_micros((F.when(v > 1e12, v / 1000).otherwise(v) * 1e6).cast("long")), F.try_to_timestamp(_c(x).cast("string")))


def truthy(x: Column | str) -> Column:
    """1, true, yes or y (SCL-17)."""
    return F.lower(F.trim(F.coalesce(_c(x).cast("string"), F.lit("")))).isin("1", "true", "yes", "y")


def bounded(x: Column | str) -> Column:
    """A number cut to 0..1, else 0 (SCL-18)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_c(x).cast("string").try_cast("double"), F.lit(0.0))))


def label_binary(x: Column | str) -> Column:
    """1 if malicious, 0 if benign or a false positive, else null (SCL-19)."""
    t = F.lower(F.trim(_c(x).cast("string")))
    return F.when(t.contains("malicious"), 1).when(t.contains("benign") | t.contains("false positive"), 0)


def lcs_ratio(seq: Column, expected: Sequence[str]) -> Column:
    """Longest common subsequence with ``expected`` (at most 62 stages) over its length, in one pass (SCL-20, 21).

    The state is one number: a row of the table by its differences, of which a bit is 0 where the row grows.
    """
    if not expected:
        return F.lit(0.0)
    if len(expected) > 62:
        raise ValueError("expected has more than 62 stages")
    every = F.lit((1 << len(expected)) - 1).cast("long")
    places = {w: sum(1 << i for i, x in enumerate(expected) if x == w) for w in expected}
    bits = F.transform(F.coalesce(seq, F.array().cast("array<string>")), lambda seen: F.coalesce(lookup(places, seen), F.lit(0)).cast("long"))

    def step(row: Column, at: Column) -> Column:
        met = row.bitwiseAND(at)
        return (row + met).bitwiseOR(row - met).bitwiseAND(every)

    return F.aggregate(bits, every, step, lambda row: (F.lit(len(expected)) - F.bit_count(row)) / F.lit(len(expected)))


def best_chain(seq: Column) -> Column:
    """The best ratio against the known attack chains (SCL-22)."""
    return F.greatest(*[lcs_ratio(seq, c) for c in K.ATTACK_CHAINS])


def stage_rank(stage: Column) -> Column:
    """Place in the kill chain, 1000 for unknown stages (WIN-05)."""
    return F.coalesce(lookup(K.STAGE_RANK, stage), F.lit(1000))


def answer_candidates(text: Column) -> Column:
    """Candidates by quoting, then addresses, links and mail addresses, without outer punctuation, first of equals (SCL-27)."""
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in K.ANSWER_PATTERNS]
    stripped = F.transform(F.concat(*found), lambda v: F.btrim(F.trim(v), F.lit(K.ANSWER_STRIP)))
    kept = F.filter(stripped, lambda v: v != "")
    folded = F.transform(kept, F.lower)
    return F.filter(kept, lambda v, i: F.array_position(folded, F.lower(v)) == i + 1)


def first_matching(candidates: Column, pattern: str) -> Column:
    """The first candidate that matches, else the first, else empty (AUX-25)."""
    return F.coalesce(F.get(F.filter(candidates, lambda v: F.regexp_like(v, F.lit(pattern))), F.lit(0)), F.get(candidates, F.lit(0)), F.lit(""))


def extract_answer(question: Column, candidates: Column) -> Column:
    """The candidate that suits the kind of question (SCL-28)."""
    q = F.lower(F.coalesce(question, F.lit("")))
    out = F.coalesce(F.get(candidates, F.lit(0)), F.lit(""))
    for words, pattern in reversed(K.ANSWER_KINDS):
        out = F.when(_any_in(q, words), first_matching(candidates, pattern)).otherwise(out)
    return out


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", " "))


def contains_answer(text: Column, answer: Column) -> Column:
    """Whether the answer, not blank, occurs in the text, blanks and case aside (SCL-30)."""
    return (squeeze(answer) != "") & squeeze(text).contains(squeeze(answer))


def answer_question(question: Column, context: Column, gold: Column, mode: str) -> Column:
    """``extractive``: by ``extract_answer``; ``gold_if_present``: the gold answer if the context has it (SCL-29)."""
    if mode == "extractive":
        return extract_answer(question, answer_candidates(context))
    if mode == "gold_if_present":
        return F.when(contains_answer(context, gold), gold).otherwise("")
    raise ValueError("mode must be 'extractive' or 'gold_if_present'")


def question_kind(text: Column) -> Column:
    """Kind of attack that a question is about (SCL-31)."""
    t = F.lower(text)
    return (
        F.when(_any_in(t, ("powershell", "command")), "command_and_control")
        .when(_any_in(t, ("password spray", "sign-in", "login")), "credential_access")
        .when(_any_in(t, ("lateral", "smb")), "lateral_movement")
        .when(_any_in(t, ("exfiltration", "inbox", "bec")), "data_exfiltration")
        .otherwise("privilege_escalation")
    )


def json_payload(x: Column | str) -> Column:
    """VARIANT of the whole text, else of its first object, else of its first list (SCL-33)."""
    c = _c(x)
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1)), F.try_parse_json(F.regexp_extract(c, r"(?s)(\[.*\])", 1)))


def title(kind: Column) -> Column:
    return F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))


def scenario_of(file: Column) -> Column:
    """File name without what follows its last underscore (SCL-36)."""
    stem = F.regexp_replace(F.regexp_replace(file, r"^.*/", ""), r"\.[^.]*$", "")
    return F.regexp_replace(stem, r"_[^_]*$", "")


def attack_day(stem: Column) -> Column:
    """The first weekday named in the stem, else the stem (SCL-38)."""
    low = F.lower(stem)
    return F.coalesce(*[F.when(low.contains(d), d) for d in K.WEEKDAYS], stem)


def parse_day(x: Column | str) -> Column:
    """Date in one of three notations (SCL-39)."""
    return F.coalesce(*[F.try_to_date(_c(x), f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd")])


def l2_normalize(v: Column) -> Column:
    """The vector over its length, or over 1e-8 if that is greater (SCL-40)."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-8)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def numeric_suffix(x: Column) -> Column:
    """The number after the last dash, 10**9 without one (SCL-41)."""
    return F.coalesce(F.regexp_extract(x, r"-(\d+)$", 1).try_cast("long"), F.lit(10**9))


def escape_cell(x: Column) -> Column:
    """Text for a Markdown cell (SCL-42)."""
    return F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def process_of(entities: Column, text: Column) -> Column:
    """The first process-like service among entities, else the first word ending in .exe (SCL-35)."""
    named = F.filter(entities, lambda e: F.regexp_like(F.lower(e["value"]), F.lit(r"\.exe\b")))
    return F.coalesce(F.get(named, F.lit(0))["value"], F.nullif(F.regexp_extract(text, r"([\w.-]+\.exe)\b", 1), F.lit("")), F.lit(""))
