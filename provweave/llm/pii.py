"""Personal data: spans by pattern, and terms that disclose them, with DataFrame functions only.

Spans of e-mail and IP addresses, card and phone numbers come from patterns (possessive and
anchored at run starts, which matches the same and keeps long runs linear).  Tokens whose own
information content is high, long mixes of digits and letters, are secrets.  All of these are the
protected entities.

A term is a word of letters.  The corpus says how strongly terms reveal entities: of N documents, n(t)
hold term t, n(e) entity e, and in n(t, e) of them t stands within ``window`` characters of e, counted
over all documents.  A term discloses e if its pointwise mutual information is at least nine tenths of
the entity's information content, ``log(n(t,e) N / (n(t) n(e))) >= 0.9 log(N / n(e))``, on
``support`` documents or more: who reads the term then knows most of what there is to know of e.  Personal data is mostly unique, so each entity is judged as its value and,
backing off, as its class (the domain of an address, the first digits of a number) and its kind.
Such a term is a span in every document that holds the value, class or kind that it discloses; one that
discloses a value in at least half of its documents is a span wherever it stands.
``redact`` generalises spans to the name of their kind.

Matches, contexts and places of words are rows, and places are running sums over a document, so
the work on a text grows with its length; only distinct terms beside entities are counted over
the corpus.

Defined results: a null text is an empty one; rows equal in id and text count as often as they
occur and are treated alike, also those without an id; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from . import text as t

KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds.
ADDED = ("secret", "term")
#: Kind: pattern, what a text must hold to be searched, and what a match m must satisfy.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+",
}
_NEEDS = {"email": "contains(text, '@')", "ip": "text RLIKE '[0-9]\\\\.[0-9]'", "card": "text RLIKE '[0-9](?:[ -]?[0-9]){12}'", "phone": "contains(text, '+')", "secret": "text RLIKE '[A-Za-z0-9]{20}'"}
_DIGITS = "regexp_replace({m}, '[^0-9]', '')"
_LUHN = """aggregate(sequence(1, length(d)), 0, (a, i) -> a + CASE WHEN (length(d) - i) % 2 = 0 THEN int(substr(d, i, 1))
  WHEN int(substr(d, i, 1)) > 4 THEN 2 * int(substr(d, i, 1)) - 9 ELSE 2 * int(substr(d, i, 1)) END) % 10 = 0"""
_HOLDS = {
    "email": "true",
    "ip": "forall(split({m}, '[.]'), p -> length(ltrim('0', p)) = 0 OR length(ltrim('0', p)) <= 3 AND int(ltrim('0', p)) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND exists(array({_DIGITS}), d -> {_LUHN})",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "secret": f"length({_DIGITS}) >= 4 AND length({{m}}) - length({_DIGITS}) >= 4",
}
#: A term: the letters of a word, without marks around them.
_TERM = "^[^\\\\p{L}]*+(\\\\p{L}[\\\\p{L}''-]*)[^\\\\p{L}]*$"
_KEY = ["id", "hash"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and what names a document: its id as text and a hash of the text."""
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.select("*", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("hash"))


#: Buckets of the bitmap of documents, of 32,768 bits each: 4 MB in all, whatever the input's size.
_BUCKETS = 1024


def _perhaps(keyed: DataFrame, some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that may be among ``some`` (id, hash), documents that are not), by a bitmap of hashes.

    The bitmap has a fixed size and is broadcast, so that the texts of documents without a match need not
    travel to a join; where very many have one it lets most pass.
    """
    place = F.pmod("hash", F.lit(_BUCKETS << 15))
    bits = some.select(place.alias("place")).groupBy(F.shiftright("place", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(32767)).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(place.bitwiseAND(32767), 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright({}, cast(pmod(hash, 8) as int))".format("byte")).bitwiseAND(1)
    rows = keyed.withColumn("bucket", F.shiftright(place, 15)).join(F.broadcast(bits), "bucket", "left")
    rows = rows.withColumn("byte", F.coalesce(byte, F.lit(0))).withColumn("perhaps", bit == 1).select(*keyed.columns, "perhaps")
    return rows.where("perhaps").drop("perhaps"), rows.where("NOT perhaps").drop("perhaps")


def _matches(kind: str, window: int) -> Column:
    """Matches of a kind in ``text``, each with the length of the gap before it and the text beside it."""
    pattern = PATTERNS[kind].replace("\\", "\\\\")
    place = (*KINDS, *ADDED).index(kind)
    return F.expr(f"""CASE WHEN {_NEEDS[kind]} THEN transform(
        array(named_struct('g', split(text, '{pattern}', -1), 'm', regexp_extract_all(text, '{pattern}', 0))),
        z -> transform(z.m, (m, i) -> named_struct('k', {place}, 'i', i, 'gap', length(z.g[i]), 'm', m, 'before', right(z.g[i], {window}), 'after', left(z.g[i + 1], {window}))))[0]
        ELSE CAST(array() AS array<struct<k:int,i:int,gap:int,m:string,before:string,after:string>>) END""")


def _entities(keyed: DataFrame, window: int) -> DataFrame:
    """id, hash, copies (rows of that document), k, start, end, value, and the text before and after."""
    kinds = (*KINDS, "secret")
    rows = keyed.select(*_KEY, F.inline(F.concat(*[_matches(k, window) for k in kinds])))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    end = F.sum(F.col("gap") + F.length("m")).over(Window.partitionBy(*_KEY, "k").orderBy("i")).cast("int")
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("m"))
    holds = "CASE k " + " ".join(f"WHEN {i} THEN {_HOLDS[k].format(m='m')}" for i, k in enumerate(kinds)) + " END"
    return rows.where(holds).select(*_KEY, "copies", "k", "start", "end", F.col("m").alias("value"), "before", "after")


def _classes(entities: DataFrame) -> DataFrame:
    """Entities once for each level at which they are judged: ``level`` 1 value, 2 class, 3 kind, and ``entity``."""
    digits = "regexp_replace(value, '[^0-9]', '')"
    kind = "element_at(array({}), k + 1)".format(", ".join(f"'{k}'" for k in (*KINDS, "secret")))
    wider = f"""CASE k WHEN 0 THEN 'email@' || lower(substring_index(value, '@', -1)) WHEN 1 THEN 'ip:' || substring_index(value, '.', 2)
      WHEN 2 THEN 'card:' || left({digits}, 6) WHEN 3 THEN 'phone:' || left({digits}, 4) END"""
    levels = F.expr(f"""filter(array(named_struct('level', 1, 'entity', {kind} || '=' || lower(value)), named_struct('level', 2, 'entity', {wider}),
        named_struct('level', 3, 'entity', {kind})), x -> x.entity IS NOT NULL)""")
    return entities.select("*", F.inline(levels))


def _terms(words: str) -> Column:
    """Distinct terms of an array of words."""
    return F.expr(f"array_distinct(filter(transform({words}, w -> regexp_extract(w, '{_TERM}', 1)), t -> length(t) >= 3))")


_SPLIT = "split({}, '[\\\\x20\\\\x09-\\\\x0D]')"


def disclosing(keyed: DataFrame, classes: DataFrame, support: int, window: int) -> DataFrame:
    """(term, entity, everywhere): terms and what they disclose."""
    # a word that the window cuts is none
    before, after = _SPLIT.format("before"), _SPLIT.format("after")
    beside = f"concat(CASE WHEN length(before) = {window} THEN slice({before}, 2, {window}) ELSE {before} END, CASE WHEN length(after) = {window} THEN slice({after}, 1, size({after}) - 1) ELSE {after} END)"
    met = classes.select(*_KEY, "copies", "level", "entity", F.explode(_terms(beside)).alias("term")).distinct()
    met = scratch.table(met, "met")
    likely = met.groupBy("term", "level", "entity").agg(F.sum("copies").alias("n_te")).where(F.col("n_te") >= support)
    n_e = scratch.table(classes.select(*_KEY, "copies", "entity").distinct().groupBy("entity").agg(F.sum("copies").alias("n_e")), "entities_held")
    total = F.lit(keyed.count()).cast("double")

    def reveals(n_t: str) -> Column:
        x = F.col("n_te").cast("double") / F.col(n_t)
        x2 = x * x
        x4 = x2 * x2
        return x4 * x4 * x2 * total >= F.col("n_e")

    # the documents where a term stands beside any entity are fewer than all that hold it: most words fall out here
    beside_any = met.select(*_KEY, "copies", "term").distinct().groupBy("term").agg(F.sum("copies").alias("n_met"))
    likely = scratch.table(likely.join(n_e, "entity").join(beside_any, "term").where(reveals("n_met")).drop("n_met"), "likely")
    words = scratch.table(likely.select("term").distinct(), "words")
    n_t = keyed.select(F.explode(_terms(_SPLIT.format("text"))).alias("term")).join(words, "term").groupBy("term").agg(F.count("*").alias("n_t"))
    told = likely.join(n_t, "term").where(reveals("n_t"))
    return told.select("term", "entity", ((F.col("level") == 1) & (2 * F.col("n_te") >= F.col("n_t"))).alias("everywhere"))


def _term_spans(keyed: DataFrame, classes: DataFrame, told: DataFrame) -> DataFrame:
    """id, hash, start, end of each place of a disclosing term."""
    words = scratch.table(told.select("term").distinct(), "told_words")
    held = keyed.select(*_KEY, F.explode(_terms(_SPLIT.format("text"))).alias("term")).join(words, "term").distinct()
    held = scratch.table(held, "held")
    # from places of terms to what they disclose, never from an entity to all of its documents and terms
    here = held.join(told.select("term", "entity"), "term").join(classes.select(*_KEY, "entity").distinct(), [*_KEY, "entity"], "left_semi").select(*_KEY, "term")
    wanted = here.unionByName(held.join(told.where("everywhere").select("term").distinct(), "term", "left_semi").select(*_KEY, "term"))
    wanted = scratch.table(wanted.distinct(), "wanted")
    texts = _perhaps(keyed, wanted)[0].select(*_KEY, "text").join(wanted.select(*_KEY).distinct().hint("merge"), _KEY).groupBy(*_KEY).agg(F.first("text").alias("text"))
    rows = texts.select(*_KEY, F.posexplode(F.expr(_SPLIT.format("text"))).alias("at", "word"))
    end = F.sum(F.length("word") + 1).over(Window.partitionBy(*_KEY).orderBy("at")).cast("int")
    rows = rows.select(*_KEY, "word", (end - F.length("word") - 1).alias("start"), F.expr(f"regexp_extract(word, '{_TERM}', 1)").alias("term"))
    start = F.col("start") + F.length(F.regexp_extract("word", "^[^\\p{L}]*+", 0))
    return rows.join(wanted, [*_KEY, "term"]).select(*_KEY, start.alias("start"), (start + F.length("term")).alias("end"))


def find(docs: DataFrame, support: int = 2, window: int = 80) -> DataFrame:
    """doc_id, text, id, hash, found (spans by pattern) and added (secrets, then terms) of every document.

    Spans are structs of k (place in KINDS and ADDED), start and end, in order.
    """
    keyed = _keyed(docs)
    entities = scratch.table(_entities(keyed, window), "entities")
    classes = _classes(entities)
    told = scratch.table(disclosing(keyed, classes, support, window), "told")
    last = len(KINDS) + ADDED.index("term")
    spans = entities.select(*_KEY, "k", "start", "end").unionByName(_term_spans(keyed, classes, told).select(*_KEY, F.lit(last).alias("k"), "start", "end"))
    spans = spans.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("k", "start", "end"))).alias("spans"))
    spans = spans.select(*_KEY, F.expr(f"filter(spans, x -> x.k < {len(KINDS)})").alias("found"), F.expr(f"filter(spans, x -> x.k >= {len(KINDS)})").alias("added"))
    none = F.array().cast("array<struct<k:int,start:int,end:int>>")
    stored = scratch.table(spans, "spans")
    perhaps, not_ = _perhaps(keyed, stored)
    rows = perhaps.join(stored.hint("merge"), _KEY, "left").select("doc_id", "text", *_KEY, F.coalesce("found", none).alias("found"), F.coalesce("added", none).alias("added"))
    return rows.unionByName(not_.select("doc_id", "text", *_KEY, none.alias("found"), none.alias("added")))


def name(k: Column) -> Column:
    """The name of a kind."""
    return F.element_at(F.array(*map(F.lit, (*KINDS, *ADDED))), k + 1)


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the first stays."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["k"].alias("k"))))
    # what lies before a span begins where the spans before it end
    step = F.aggregate(
        ordered, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, x: F.when(x["start"] >= a["at"], F.struct(x["end"].alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.concat(F.lit("["), F.upper(name(x["k"])), F.lit("]")))).alias("out")))
        .otherwise(F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, step).otherwise(text)


def redact(found: DataFrame) -> DataFrame:
    """doc_id and text of the result of ``find`` with every span generalised."""
    return found.select("doc_id", redacted(F.col("text"), F.concat("found", "added")).alias("text"))
