"""Words whose bytes were read in a wrong encoding, and their original text.

Every distinct text of a language gets the readings that undo a chain "written as A, read
as B", each with its log likelihood in the language's character model; a text with
replacement characters has the one reading that they hide what can't be told. Expectation-
maximization treats the chain as latent: the E step gives each text's posterior over chains
inside its row, as arrays; the M step the share of each chain in the language and in the
record's source and field, so that weak evidence of many words adds up; both are iterated.
A word is repaired by the best posterior. The same operator serves any field: a field's
cells have a source of their own (the document for words, the font for glyphs).

Texts are counted and scored once a language, whatever the number of their records. What
moves between steps are expected counts by chain, added up before they are shuffled; of a
source there is one small row, dealt over SALTS parts where its texts are.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from docveil.functions.arrays import let
from docveil.llm.char_model import CharModel, count
from docveil.llm.codepoints import flat
from docveil.llm.consistent import plain
from docveil.llm.scripts import LANGS, LATIN_EXTRA, UNKNOWN, lang_index

# Encodings that texts were written in, by language, and those that they were taken for.
WRITTEN = {
    "fr": ["cp1252", "mac_roman", "cp437", "cp850"], "en": ["cp1252", "mac_roman", "cp437", "cp850"], "de": ["cp1252", "mac_roman", "cp437", "cp850"], "es": ["cp1252", "mac_roman", "cp437", "cp850"],
    "ru": ["cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic"], "el": ["cp1253", "iso8859_7", "cp737"], "ja": ["cp932", "euc_jp"], "zh": ["gb18030", "big5"],
    "hi": [], "ar": ["cp1256", "iso8859_6"], "th": ["cp874"],
}
TAKEN_FOR = ["cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866", "cp1253", "gb18030"]
SEVERAL = {"gb18030", "cp932", "big5", "euc_jp"}
LOSSY, LOST = "lossy", "\ufffd"
#: Log odds of a reading that puts letters of another script into what looks like the name of a mailbox or site.
IN_NAME = -20.0
#: A reading so far below the text itself is let go. As shares add up to 1 at most and the text keeps a weight of LEAST,
#: all such readings together have a posterior below exp(-FAR) / LEAST = 0.34: they can't win.
FAR, LEAST = 8.0, 1e-3
#: Log odds of a word written with look-alikes, which competes with the chains.
ALIKE = -3.0
#: Prior share of wrong words before anything is known, the weight of the language's shares in a source, and rounds of EM.
PRIOR, POOL, ROUNDS = 0.02, 1.0, 4
#: Share of a chain that the language doesn't show, and parts that a source's texts are dealt over.
UNSEEN, SALTS = 1e-5, 16
#: EM of the sources ends when no chain's expected number of words in any source moves by more than this part of itself (and 0.05 words), or after so many rounds.
SETTLED, SOURCE_ROUNDS = 0.05, 12


@lru_cache(None)
def byte_of(encoding: str) -> dict[str, int]:
    """Character -> byte above 0x7F; bytes without a character are read as C1 controls."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


@lru_cache(None)
def letters_of(encoding: str) -> dict[int, str]:
    return {b: c for c, b in byte_of(encoding).items()}


def parts(word: str, taken: str) -> list[str | bytes]:
    """The word as stretches of bytes of the encoding it was taken for, and of characters that this doesn't have."""
    out: list = []
    run = bytearray()
    table = None if taken in SEVERAL else byte_of(taken)
    for c in word:
        if c < "\x80":
            run.append(ord(c))
            continue
        if table is not None:
            b = table.get(c)
            code = None if b is None else bytes([b])
        else:
            try:
                code = c.encode(taken)
            except UnicodeEncodeError:
                code = None
        if code is None:
            if run:
                out.append(bytes(run))
                run = bytearray()
            out.append(c)
        else:
            run += code
    if run:
        out.append(bytes(run))
    return out


def read(stretches: list[str | bytes], written: str) -> str | None:
    out = []
    for s in stretches:
        if isinstance(s, str):
            out.append(s)
        elif written in SEVERAL or written == "utf-8":
            try:
                out.append(s.decode(written))
            except UnicodeDecodeError:
                return None
        else:
            table = letters_of(written)
            out.append("".join(chr(b) if b < 0x80 else table[b] for b in s))
    return "".join(out)


_latin_run = re.compile(r"[A-Za-z0-9À-ÿ._%+@\-]{5,}")


def has_latin_name(word: str) -> bool:
    """Whether the word holds a run of ASCII letters with one or two accented ones inside, as names of mailboxes and sites have."""
    for m in _latin_run.finditer(word):
        strange = [i for i, c in enumerate(m[0]) if c > "\x7f"]
        if 1 <= len(strange) <= 2 and sum(c.isascii() and c.isalpha() for c in m[0]) >= 4:
            if any(0 < i < len(m[0]) - 1 and m[0][i - 1].isascii() and m[0][i + 1].isascii() for i in strange):
                return True
    return False


def readings(word: str, langs: tuple[str, ...]) -> dict[str, str]:
    """Chain name -> the text that the chain would have come from, where that differs from the word."""
    out: dict[str, str] = {}
    if LOST in word:
        return {LOSSY: word}
    seen = set()
    for taken in TAKEN_FOR:
        stretches = parts(word, taken)
        if not any(isinstance(s, bytes) and max(s) > 0x7F for s in stretches):
            continue
        for written in ("utf-8", *dict.fromkeys(w for lang in langs for w in WRITTEN[lang])):
            if written == taken:
                continue
            text = read(stretches, written)
            if text is None or text == word or text in seen:
                continue
            seen.add(text)
            out[f"{written}>{taken}"] = text
            if written == "utf-8" and taken in ("cp1252", "latin_1"):
                twice = read(parts(text, taken), "utf-8")
                if twice is not None and twice != text and twice not in seen:
                    seen.add(twice)
                    out[f"{written}>{taken}>{written}>{taken}"] = twice
    return out


TYPE_DDL = "lang string, text string, n long, base double, chains array<string>, texts array<string>, scores array<double>"


def scored(kinds: DataFrame, model) -> DataFrame:
    """(lang, text, n), distinct, with non-ASCII text -> its own score and its readings with theirs; texts without any are left out."""

    def run(batches):
        m = CharModel(model.value)
        for batch in batches:
            texts, langs = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            index = lang_index(langs)
            found = [readings(t, (LANGS[i],) if i != UNKNOWN else tuple(LANGS)) for t, i in zip(texts, index)]
            sizes = np.array([len(f) for f in found], np.int64)
            alike = plain(batch.column(1), index).to_pylist()
            flat_texts = [*texts, *alike, *(r for f in found for r in f.values())]
            every = np.arange(len(texts))
            row = np.repeat(every, sizes)
            owner = np.concatenate([every, every, row])
            cp, offsets = flat(pa.array(flat_texts, pa.string()))
            score = m.score(cp, offsets, index[owner], skip=ord(LOST))
            whole = m.score(cp[: offsets[len(texts)]], offsets[: len(texts) + 1], index)
            base = np.maximum(whole, score[len(texts) : 2 * len(texts)] + ALIKE)
            # look-alikes can't stand for what is lost
            base = np.where([LOSSY in f for f in found], whole, base)
            own = score[2 * len(texts) :]
            names = [c for f in found for c in f]
            foreign = np.array([i == UNKNOWN or LANGS[i] not in LATIN_EXTRA for i in index], bool)
            named = np.array([bool(k) and bool(f) and has_latin_name(t) for k, f, t in zip(foreign, found, texts)], bool)
            own = own + IN_NAME * (named[row] & ~np.array([c.startswith("utf-8") for c in names], bool))
            keep = own > base[row] - FAR
            n = np.bincount(row[keep], minlength=len(texts))
            some = n > 0
            at = np.flatnonzero(keep)
            cut = pa.array(np.concatenate([[0], np.cumsum(n[some])]), pa.int32())
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in ([names[k] for k in at], [flat_texts[2 * len(texts) + k] for k in at], own[at])]
            lists = [x.cast(pa.list_(t)) for x, t in zip(lists, (pa.string(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(c.filter(pa.array(some)) for c in batch.columns), pa.array(base[some]), *lists], names=["lang", "text", "n", "base", "chains", "texts", "scores"])

    return kinds.mapInArrow(run, TYPE_DDL)


def weighed(types: DataFrame, shares: dict[tuple[str, str], float], prior: DataFrame | None) -> DataFrame:
    """types with `ps`, the posterior of each of their readings; shares of chains come from the language and, if given, from the source.

    prior: source, salt, counts (map of a chain's expected number), source_n.
    """
    by_lang: dict[str, dict[str, float]] = {}
    for (lang, chain), v in shares.items():
        by_lang.setdefault(lang, {})[chain] = v
    # one row for each of the LANGS, each with no more chains than pairs of encodings
    usual = types.sparkSession.createDataFrame(list(by_lang.items()), "usual_lang string, usual map<string,double>")
    rows = types.join(F.broadcast(usual), F.coalesce("lang", F.lit("")) == F.col("usual_lang"), "left").drop("usual_lang")
    usual = lambda c: F.coalesce(F.col("usual")[c], F.lit(UNSEEN))
    if prior is None:
        share = F.transform("chains", usual)
    else:
        rows = rows.join(prior, ["source", "salt"], "left")
        share = F.transform("chains", lambda c: (F.coalesce(F.col("counts")[c], F.lit(0.0)) + POOL * usual(c)) / (F.coalesce("source_n", F.lit(0)) + POOL))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def odds(x):
        """Of the readings, and of the text being right."""
        right = F.greatest(1 - total(x["share"]), F.lit(LEAST)) * F.exp(F.col("base") - x["top"])
        return F.struct(F.zip_with(x["share"], F.col("scores"), lambda a, s: a * F.exp(s - x["top"])).alias("odds"), right.alias("right"))

    every = let(F.struct(share.alias("share"), F.greatest("base", F.array_max("scores")).alias("top")), odds)
    ps = let(every, lambda x: let(F.struct(x["odds"].alias("odds"), (total(x["odds"]) + x["right"]).alias("sum")), lambda y: F.transform(y["odds"], lambda o: o / y["sum"])))
    # a generator keeps the optimizer from repeating the work wherever its result is used
    return rows.withColumn("ps", F.explode(F.array(ps))).drop("usual")


def language_shares(kinds: DataFrame, sizes: dict[str, int]) -> dict[tuple[str, str], float]:
    """Shares of chains by language; as small as languages times chains."""
    pairs = {(r["lang"] or "", r["chain"]) for r in kinds.select("lang", F.explode("chains").alias("chain")).distinct().collect()}
    each = {lang: sum(x == lang for x, _ in pairs) for lang, _ in pairs}
    shares = {(lang, chain): PRIOR / each[lang] for lang, chain in pairs}
    for _ in range(ROUNDS if pairs else 0):
        moved = weighed(kinds, shares, None).select("lang", "n", F.explode(F.arrays_zip("chains", "ps")).alias("one_reading"))
        got = moved.groupBy("lang", F.col("one_reading.chains").alias("chain")).agg(F.sum(F.col("one_reading.ps") * F.col("n")).alias("n")).collect()
        shares = {(r["lang"] or "", r["chain"]): (r["n"] + 0.05) / (sizes.get(r["lang"] or "", 0) + 100) for r in got}
    return shares


def source_counts(types: DataFrame, shares: dict, sizes: DataFrame, checkpoint) -> DataFrame:
    """source, salt, counts, source_n after EM by source, which goes on from the languages' shares until it settles."""
    prior = None
    for _ in range(SOURCE_ROUNDS):
        last = F.lit(0.0) if prior is None else F.coalesce(F.col("counts")[F.col("one_reading.chains")], F.lit(0.0))
        moved = weighed(types, shares, prior).withColumn("one_reading", F.explode(F.arrays_zip("chains", "ps"))).select("source", F.col("one_reading.chains").alias("chain"), (F.col("one_reading.ps") * F.col("n")).alias("m"), last.alias("last"))
        mass = moved.groupBy("source", "chain").agg(F.sum("m").alias("m"), F.max("last").alias("last"))
        one = mass.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("chain", "m"))).alias("counts"), F.max(F.abs(F.col("m") - F.col("last")) / (F.col("m") + 0.05)).alias("moved"))
        one = checkpoint(one.join(sizes, "source", "left"))
        most = one.agg(F.max("moved").alias("m")).first()["m"]
        prior = one.select("source", "counts", "source_n", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        if (most or 0.0) <= SETTLED:
            break
    return prior


def normal(cells: DataFrame) -> DataFrame:
    """cells that have text, in a language that is known or null."""
    return cells.where(F.col("text").isNotNull() & (F.col("text") != "")).withColumn("lang", F.when(F.lower("lang").isin(LANGS), F.lower("lang")))


def strange(text) -> F.Column:
    """Whether a text has a character beyond ASCII: no other can be wrong."""
    return F.regexp_like(text, F.lit(r"[^\x00-\x7F]"))


def same_text(a: str, b: str, source: bool = True) -> F.Column:
    """Join of two tables by source (if wanted), language and text."""
    out = F.col(f"{a}.lang").eqNullSafe(F.col(f"{b}.lang")) & (F.col(f"{a}.text") == F.col(f"{b}.text"))
    return out & F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source")) if source else out


def wrong_texts(cells: DataFrame, corpus: DataFrame, checkpoint) -> DataFrame:
    """(source, lang, text, restored, chain, posterior) of the distinct wrong texts of each source.

    cells: source, lang, text of the records to judge; corpus: the same of all there are,
    for the character model and the sources' sizes. Duplicate rows weigh as they come.
    """
    spark = cells.sparkSession
    corpus = normal(corpus)
    kinds = checkpoint(corpus.groupBy("lang", "text").agg(F.count("*").alias("n")))
    model = spark.sparkContext.broadcast(count(kinds.select("text", "lang", "n")))
    # Python takes long for each row: all shuffle partitions are kept
    few = kinds.where(strange("text")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    readable = checkpoint(scored(few, model))
    sizes = {r["lang"] or "": r["n"] for r in kinds.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    shares = language_shares(readable, sizes)
    own = normal(cells).where(strange("text")).select("source", "lang", "text")
    types = own.alias("c").join(readable.drop("n").alias("r"), same_text("c", "r", False)).groupBy("c.source", "c.lang", "c.text").agg(F.count("*").alias("n"))
    types = types.alias("c").join(readable.drop("n").alias("r"), same_text("c", "r", False)).select("c.*", "r.base", "r.chains", "r.texts", "r.scores")
    types = checkpoint(types.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int")))
    # the rounds need neither the texts nor their readings
    prior = source_counts(types.drop("text", "texts"), shares, corpus.groupBy("source").agg(F.count("*").alias("source_n")), checkpoint)
    done = weighed(types, shares, prior).withColumn("posterior", F.aggregate("ps", F.lit(0.0), lambda a, v: a + v)).where("posterior > 0.5")
    best = (F.array_position("ps", F.array_max("ps")) - 1).cast("int")
    restored = F.when(F.get("chains", best) != LOSSY, F.get("texts", best))
    return done.select("source", "lang", "text", restored.alias("restored"), F.get("chains", best).alias("chain"), "posterior")


def wrong_cells(cells: DataFrame, wrong: DataFrame, keys: list[str]) -> DataFrame:
    """Wrong cells: keys, lang, text, restored, chain, posterior; duplicate rows give one."""
    own = normal(cells).where(strange("text"))
    out = own.alias("c").join(wrong.alias("w"), same_text("c", "w")).select(*[f"c.{k}" for k in keys], "c.lang", "c.text", "w.restored", "w.chain", "w.posterior")
    return out.dropDuplicates(keys)


def repair(cells: DataFrame, keys: list[str], checkpoint, corpus: DataFrame | None = None) -> DataFrame:
    """Wrong cells of (keys..., source, lang, text): keys, lang, text, restored (null if it can't be told), chain, posterior.

    Null and empty texts are never wrong. Duplicate rows give one row. A text of unknown
    language is read in the encodings of all languages. `corpus` has all texts with source
    and lang, where cells are only some of them.
    """
    wrong = wrong_texts(cells, cells if corpus is None else corpus, checkpoint)
    return wrong_cells(cells, wrong, keys)


def wrong_glyphs(decoders: DataFrame, letters: DataFrame, wrong: DataFrame) -> DataFrame:
    """Entries of fonts' maps that hold wrong characters: doc, font_no, code, value, restored (null if it can't be told), n_letters.

    A map has no language of its own, so its letters vote: an entry is wrong if most of
    the letters drawn with it stand in wrong words and, where the word's characters stand
    one for one against the restored ones, differ from them. `letters` has doc, page_no,
    word_no, seq, value, font_no; `wrong` is what repair() gives for words, keyed by doc,
    page_no, word_no. Null maps and values, and codes that no letter uses, have no row.
    """
    word = ["doc", "page_no", "word_no"]
    own = letters.where("value is not null and font_no is not null and word_no is not null").dropDuplicates(["doc", "page_no", "seq"]).select(*word, "seq", "value", "font_no")
    found = wrong.select(*word, "restored", F.char_length("text").alias("n_text"))
    place = F.row_number().over(W.partitionBy(*word).orderBy("seq"))
    inside = own.join(found, word).withColumn("place", place)
    # only a restored form of the same length tells characters one by one
    inside = inside.withColumn("plain", F.when(F.char_length("restored") == F.col("n_text"), F.expr("substring(restored, place, 1)")))
    bad = inside.where("plain is null or plain <> value").groupBy("doc", "font_no", "value").agg(F.count("*").alias("n_bad"), F.mode("plain").alias("restored"))
    every = own.where(F.col("value") > "\x7f").groupBy("doc", "font_no", "value").agg(F.count("*").alias("n_letters"))
    marked = every.join(bad, ["doc", "font_no", "value"]).where("2 * n_bad > n_letters").drop("n_bad")
    maps = decoders.dropDuplicates(["doc", "font_no"]).select("doc", "font_no", F.explode("code_to_char").alias("code", "value")).where("value is not null")
    return maps.join(marked, ["doc", "font_no", "value"]).select("doc", "font_no", "code", "value", "restored", "n_letters")
