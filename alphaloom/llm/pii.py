"""Personal data: exact patterns, and bootstrapped contextual extraction from them, in DataFrame operations only.

The base kinds are found by their patterns. They are the seeds, and what stands around a seed gives lexical patterns of
three kinds: the two words before it; the word before it and its shape; its shape and the word after it. A shape is a
text with runs of letters as `a` and runs of up to four digits as `9`, longer ones as so many; it is only taken of what
has a digit or an `@`. A pattern's instances are the seeds and tokens that it fits anywhere in the corpus.

On the graph of patterns and instances a pattern's share s is the sum of its instances' confidence over their number and
one, that of a seed being 1 and that of any other instance 0 at first. Its confidence is 1 - (1 - s) ** VOUCHED: the
pattern vouches for what it fits, and this for the pattern, so many times. A pattern of SEEDS distinct seeds or more
whose confidence reaches CONFIDENT is accepted; what it fits and has a digit or an `@` becomes known, with its confidence,
and raises the share of other patterns (a plain word is found as well, but says nothing of other patterns, as it may stand
anywhere). This goes on until no pattern is accepted any more. What accepted patterns fit are new identifiers, of
kind `context`. Nothing else decides: no count or size of what else the corpus holds.

Tokens with a digit or an `@` are all that is or could ever be known, and all that patterns with a shape fit. They are taken
first; so what could be known of a pattern is counted before any round. Many patterns of two words fit far more plain words
than that, and those edges are never made: the plain words found in a part of the texts are a lower bound of their number,
and a pattern is only left out where it couldn't be accepted if all that could be known of it were. As no round raises
that bound, the texts are read equally often whatever becomes known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alphaloom.llm.common import scratch, spread_join, text_of

#: The base kinds in order, and the patterns. Those here are possessive forms that find the same spans in linear time.
BASE = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
_EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_FIRST = r"^[^\p{L}\p{N}+]+"
_BLOCK = 128  # words; a text is cut so that its places are found without the whole of it
_CHUNK = 256
SPANS = "array<struct<kind:string,start:long,end:long>>"
_FOUND = "array<struct<start:long,end:long,match:string,left:string,right:string>>"
_SEEN = "array<struct<kind:string,start:long,end:long,match:string,left:string,right:string>>"
CONFIDENT = 0.5
VOUCHED = 4
SEEDS = 3
#: The share at which a pattern is accepted.
_LEAST = 1 - (1 - CONFIDENT) ** (1 / VOUCHED)
#: What only instances that may become known have.
_SIGN = "[0-9@]"
#: Parts of the texts, by their hashes, in which plain words are counted first: one in so many.
PARTS = (64, 8)
#: Patterns or instances up to which they are broadcast, some 100 bytes each.
BROADCAST_ROWS = 200_000


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column) -> Column:
    """How much comes before each element of an array of whole numbers.

    A running sum that grows an array copies it with every element; so it is made for _CHUNK elements at a time, and
    then for the sums of these.
    """
    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("before"))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before"))
    summed = lambda a: F.aggregate(a, none, step)
    count = F.ceil(F.size(lengths) / _CHUNK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: summed(F.slice(lengths, i * _CHUNK + 1, F.lit(_CHUNK))))
    both = lambda cs: F.zip_with(cs, summed(F.transform(cs, lambda c: c["at"]))["before"], lambda c, o: F.transform(c["before"], lambda x: x + o))
    return F.flatten(_let(cut, both))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match, left, right) of the leftmost non-overlapping matches, in code points; left and right: what stands there, no further than two matches away, left with a line's end where the text begins.

    Spark has no positions of all matches; they follow from the lengths of the matches and of what lies between them.
    """
    pieces = F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def placed(p: Column) -> Column:
        between = lambda i: F.coalesce(F.get(p["between"], i), F.lit(""))
        match = lambda i: F.coalesce(F.get(p["match"], i), F.lit(""))

        def one(m: Column, i: Column) -> Column:
            skip = F.length(between(i)).cast("long")
            before = lambda k: F.when(i >= k, F.concat(between(i - k), match(i - k))).otherwise(F.lit(""))
            left = F.concat(F.when(i <= 2, F.lit("\n")).otherwise(F.lit("")), before(2), before(1), between(i))
            right = F.concat(between(i + 1), match(i + 1), between(i + 2))
            return F.struct((skip + F.length(m)).alias("step"), skip.alias("skip"), m.alias("match"), left.alias("left"), right.alias("right"))

        def spans(found: Column) -> Column:
            span = lambda before, x: F.struct((before + x["skip"]).alias("start"), (before + x["step"]).alias("end"), x["match"].alias("match"), x["left"].alias("left"), x["right"].alias("right"))
            return F.zip_with(running(F.transform(found, lambda x: x["step"])), found, span)

        return F.when(F.size(p["match"]) > 0, _let(F.transform(p["match"], one), spans)).otherwise(F.array().cast(_FOUND))

    return _let(pieces, placed)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """From the last digit on, every second one is doubled, less nine if over nine; the sum must be a multiple of ten."""
    worth = F.transform(
        F.array_remove(F.split(F.reverse(digits), ""), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(worth, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def _kind(name: str, found: Column, holds) -> Column:
    kept = F.filter(found, lambda m: holds(m["match"])) if holds else found
    return F.transform(kept, lambda m: F.struct(F.lit(name).alias("kind"), *(m[c].alias(c) for c in ("start", "end", "match", "left", "right"))))


def _seen(text: Column) -> Column:
    """The base kinds' matches (_SEEN), by kind as listed, then by start. Patterns run only over texts that have their sign."""
    between = lambda s, low, high: F.length(_digits(s)).between(low, high)
    if_ = lambda sign, spans: F.when(sign, spans).otherwise(F.array().cast(_SEEN))
    digit = text.rlike("[0-9]")
    return F.concat(
        if_(F.contains(text, F.lit("@")), _kind("email", matches(text, _EMAIL), None)),
        if_(digit, _kind("ip", matches(text, _IP), lambda s: s.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))),
        if_(digit, _kind("card", matches(text, _CARD), lambda s: F.when(between(s, 13, 19), _luhn(_digits(s))).otherwise(False))),
        if_(F.contains(text, F.lit("+")), _kind("phone", matches(text, _PHONE), lambda s: between(s, 9, 15))),
    )


def _spans(seen: Column) -> Column:
    return F.transform(seen, lambda m: F.struct(*(m[c].alias(c) for c in ("kind", "start", "end"))))


def base_spans(text: Column) -> Column:
    """The base kinds' spans, by kind as listed, then by start."""
    return _spans(_seen(text))


def _shape(x: Column) -> Column:
    """The shape of a text in lower case; null without a digit or an `@`."""
    digits = F.regexp_replace(F.regexp_replace(x, r"\p{L}++", "a"), "[0-9]", "9")
    return F.when(x.rlike(_SIGN), F.regexp_replace(digits, r"(?<!9)9{1,4}+(?!9)", "9"))


def _core(token: Column) -> Column:
    """A token without what stands around its letters and digits."""
    return F.regexp_replace(token, _FIRST + r"|[^\p{L}\p{N}]+$", "")


def _key(kind: str, x: Column, y: Column) -> Column:
    """The pattern of two parts; null if one is."""
    return F.when(x.isNotNull() & y.isNotNull(), F.xxhash64(F.lit(kind), x, y))


def _keys(m: Column, instance: Column) -> Column:
    """The patterns of a match (of left, right): of the two words before its token, of the second and the instance's shape, of this and the word after. Each is null if a part is."""
    some = lambda x: F.when(x != "", F.lower(x))
    before = lambda between: some(F.regexp_extract(m["left"], rf"\s(\S++)\s++{between}\S*+\z", 1))  # noqa: E731  \z: $ is also before a line's end
    second, shape = before(""), _shape(instance)
    after = some(F.regexp_extract(m["right"], r"^\S*+\s++(\S++)", 1))
    return F.array(_key("two", before(r"\S++\s++"), second), _key("left", second, shape), _key("right", shape, after))


def _seeds(seen: Column) -> Column:
    """The patterns around base matches: (pattern, instance); a match may begin or end within a token."""

    def one(m: Column) -> Column:
        instance = F.lower(m["match"])
        return F.transform(F.array_compact(_keys(m, instance)), lambda k: F.struct(k.alias("pattern"), instance.alias("instance")))

    return F.flatten(F.transform(seen, one))


def _signed(source: DataFrame, able: DataFrame) -> DataFrame:
    """blob, pattern, instance, start, end of the tokens in source (blob, text) that have a digit or an `@`, for the patterns around them that are in able."""
    found = source.where(F.col("text").rlike(_SIGN)).select("blob", F.explode(matches(F.col("text"), _SIGN + r"\S*+")).alias("m"))
    found = found.withColumn("head", F.regexp_extract("m.left", r"(?<!\S)\S*+\z", 0)).withColumn("token", F.concat("head", "m.match"))
    found = found.withColumn("instance", _core(F.lower("token"))).withColumn("begin", F.col("m.start") - F.length("head"))
    rows = found.select("blob", "instance", "token", "begin", F.explode(_keys(F.col("m"), F.col("instance"))).alias("pattern")).where("pattern is not null")
    return _among(rows, able, "pattern").select("blob", "pattern", "instance", *_place(F.col("begin"), F.col("token"))).distinct()


def _plain(source: DataFrame, able: DataFrame, *columns: str) -> DataFrame:
    """word, pattern and columns (of blob, from, block, i) of the other tokens in source (blob, text) that patterns of two words in able fit: the i-th of its block, which begins at `from`."""
    body = F.regexp_replace("text", r"^\s+", "")
    source = source.select("blob", (F.length("text") - F.length(body)).cast("long").alias("lead"), F.regexp_extract_all(body, F.lit(rf"(?:\S++\s*+){{1,{_BLOCK}}}"), F.lit(0)).alias("blocks"))
    # Each block is given the first two words of the next, which are its own tokens then: they have the words before them.
    starts = F.transform(running(F.transform("blocks", lambda b: F.length(b).cast("long"))), lambda x: x + F.col("lead"))

    def cut(v: Column) -> Column:
        ahead = lambda i: F.regexp_extract(F.coalesce(F.get(v["blocks"], i + 1), F.lit("")), r"^(?:\S++\s*+){1,2}", 0)
        return F.transform(v["blocks"], lambda b, i: F.struct(F.get(v["starts"], i).alias("from"), F.concat(b, ahead(i)).alias("block")))

    each = source.where(F.size("blocks") > 0).select("blob", F.explode(_let(F.struct(F.col("blocks").alias("blocks"), starts.alias("starts")), cut)).alias("b")).select("blob", "b.*")
    each = each.withColumn("words", F.split(F.lower(F.rtrim(F.regexp_replace("block", r"\s+", " "))), " "))
    # One row a token, its words around taken from the array by place: functions of arrays would be far slower here.
    rows = each.select("*", F.posexplode("words").alias("i", "word")).where((F.col("i") >= 2) & ~F.col("word").rlike(_SIGN))
    word = lambda n: F.get("words", F.col("i") + n)
    return _among(rows.select(*columns, "word", _key("two", word(-2), word(-1)).alias("pattern")), able, "pattern")


def _among(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in known, a stored table, which is broadcast if it is small."""
    return rows.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, key, "left_semi")


def _place(begin: Column, token: Column) -> tuple[Column, Column]:
    """Where the core of a token that begins there starts and ends."""
    start = begin + F.length(token) - F.length(F.regexp_replace(token, _FIRST, ""))
    return start.alias("start"), (start + F.length(_core(token))).alias("end")


def _placed(tokens: DataFrame) -> DataFrame:
    """blob, pattern, instance, start, end of tokens (as of _plain)."""
    found = tokens.withColumn("pieces", F.regexp_extract_all("block", F.lit(r"\S++\s*+"), F.lit(0)))
    begin = F.col("from") + F.length(F.array_join(F.slice("pieces", F.lit(1), F.col("i")), ""))
    token = F.regexp_extract(F.get("pieces", F.col("i")), r"^\S+", 0)
    return found.select("blob", "pattern", _core(F.col("word")).alias("instance"), *_place(begin, token)).distinct()


def accepted_patterns(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pattern) of those that are accepted and (instance) of what is known by them beyond seeds; edges: distinct (pattern, instance, seed), of patterns of SEEDS seeds or more.

    A pattern's share only grows, and an instance keeps the one with which it becomes known; so the rounds end, and
    their result hangs on no order. Each round joins only what the one before has made known.
    """
    others = edges.where(~F.col("seed") & F.col("instance").rlike(_SIGN)).select("pattern", "instance")
    state = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.col("seed").cast("double")).alias("total")).withColumn("round", F.lit(None).cast("int"))
    share = F.col("total") / (F.col("n") + 1)  # one is added, so that few instances count less
    confidence = 1 - F.pow(1 - share, F.lit(VOUCHED))
    known, done = others.where("false").select("instance"), 0
    while True:
        fresh = F.col("round").isNull() & (share >= _LEAST)
        state = scratch(state.withColumn("round", F.when(fresh, done).otherwise(F.col("round"))))
        new = state.where(F.col("round") == done)
        if not new.limit(1).count():
            return state.where("round is not null").select("pattern"), known
        found = others.join(new.select("pattern", confidence.alias("p")), "pattern").groupBy("instance").agg(F.max("p").alias("p"))
        found = scratch(found.join(known, "instance", "left_anti") if done else found)
        known = known.unionByName(found.select("instance"))
        gained = others.join(found, "instance").groupBy("pattern").agg(F.sum("p").alias("gained"))
        state = state.join(gained, "pattern", "left").select("pattern", "n", (F.col("total") + F.coalesce("gained", F.lit(0.0))).alias("total"), "round")
        done += 1


def _possible(source: DataFrame, able: DataFrame) -> DataFrame:
    """Of able (pattern, most) those that could be accepted if `most` of their instances were known: in no part of the texts there are too many plain words beside these."""
    able = scratch(able)
    for part in PARTS:
        texts = source.where(F.pmod(F.xxhash64(F.lit(11), "blob"), F.lit(part)) == 0)
        counted = _plain(texts, able).groupBy("pattern").agg(F.countDistinct(_core(F.col("word"))).alias("n"))
        able = scratch(able.join(counted, "pattern", "left").where(F.col("most") >= _LEAST * (F.col("most") + F.coalesce("n", F.lit(0)) + 1)).select("pattern", "most"))
    return able.select("pattern")


def _bases(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs as (doc_id, blob, text), and (doc_id, blob, base, seeds) of the same rows; blob: the text's hash."""
    text = text_of()
    source = docs.select("doc_id", F.sha2(text.cast("binary"), 256).alias("blob"), text.alias("text"))
    seen = source.select("doc_id", "blob", _seen(F.col("text")).alias("seen"))
    both = _let(F.col("seen"), lambda m: F.struct(_spans(m).alias("base"), _seeds(m).alias("seeds")))
    return source, scratch(seen.select("doc_id", "blob", both.alias("both")).select("doc_id", "blob", "both.*"))


def _discovered(source: DataFrame, seeds: DataFrame) -> DataFrame:
    """blob, instance, start and end of what accepted patterns fit in source (blob, text); seeds: distinct (pattern, instance)."""
    source, seeds = source.select("blob", "text"), scratch(seeds)
    able = scratch(seeds.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SEEDS).select("pattern"))
    signed = scratch(_signed(source, able))
    edge = lambda rows, seed: rows.select("pattern", "instance", F.lit(seed).alias("seed"))
    edges = edge(_among(seeds, able, "pattern"), True).unionByName(edge(signed, False))
    most = edges.where(F.col("instance").rlike(_SIGN)).groupBy("pattern").agg(F.countDistinct("instance").alias("most"))
    possible = scratch(_possible(source, most))
    plain = scratch(_placed(_plain(source, possible, "blob", "from", "block", "i")))
    edges = _among(edges, possible, "pattern").unionByName(edge(plain, False)).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    accepted, _ = accepted_patterns(scratch(edges))
    tokens = signed.unionByName(plain)
    return tokens.join(scratch(accepted), "pattern", "left_semi").select("blob", "instance", "start", "end").distinct()


def _new_spans(found: DataFrame, spans: DataFrame) -> DataFrame:
    """Of found (blob, start, end, ...) those that overlap none of spans (blob, base)."""
    overlaps = F.exists(F.coalesce("base", F.array().cast(SPANS)), lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    return found.join(spans, "blob", "left").where(~overlaps).drop("base")


def _once(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("base") > 0).groupBy("blob").agg(F.first("base").alias("base"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans of every row of docs (doc_id, text): base spans, and those with the `context` spans after them.

    A `context` span is a token without what stands around its letters and digits; it overlaps no base span. A word that is
    glued to more than two base matches counts from the second on. A null text counts as empty and has none. Repeated rows
    are answered each; in the graph an edge counts once however often it occurs, so a group of copies weighs no more than
    one text. Other columns are ignored.
    """
    source, rows = _bases(docs)
    found = _discovered(source, rows.select(F.explode("seeds").alias("s")).select("s.*").distinct())
    new = _new_spans(found, _once(rows)).groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("new"))
    new = new.select("blob", F.transform("new", lambda s: F.struct(F.lit("context").alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("new"))
    out = spread_join(rows.select("doc_id", "blob", "base"), new, "blob")
    return out.select("doc_id", "base", F.concat("base", F.coalesce("new", F.array().cast(SPANS))).alias("spans"))


def rediscovery(docs: DataFrame) -> DataFrame:
    """How well patterns find what they weren't taught: half of the seeds, by a hash, teach; one row tells how many others there are (n_hidden), how many of these the patterns find (n_found), and what else they find (n_other). All count distinct instances."""
    source, rows = _bases(docs)
    seeds = rows.select(F.explode("seeds").alias("s")).select("s.*").distinct()
    taught = F.pmod(F.xxhash64(F.lit(5), "instance"), F.lit(2)) == 0
    found = _discovered(source, seeds.where(taught)).select("instance").distinct()
    hidden = seeds.where(~taught).select("instance").distinct().withColumn("hidden", F.lit(True))
    both = found.withColumn("found", F.lit(True)).join(hidden, "instance", "full").join(seeds.where(taught).select("instance").distinct(), "instance", "left_anti")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    return both.agg(F.count_if(is_("hidden")).alias("n_hidden"), F.count_if(is_("hidden") & is_("found")).alias("n_found"), F.count_if(~is_("hidden")).alias("n_other"))
