"""Words stored through a wrong character decoding (problem 1).

The distinct words of all tables that can be such forms (with a character beyond ASCII, or with a question mark before
a letter) are gathered once.

1. Originals: every clean one of these words, and for every word that decodes along some chain the text it decodes to,
   if that is plausible. Decoding back only proposes; it decides nothing.
2. Forms: the garbled forms of every distinct original under all encoding chains (its UTF-8 bytes read as another
   encoding, up to ``MAX_LAYERS`` times over; bytes that were lost to U+FFFD or a question mark; the same in changed
   case).
3. The stored words are hash-joined with this table of forms, and verified originals take their place. A proposed original
   that does not give the very word when garbled again joins nothing.

A word with U+FFFD that is the form of no original, or of several equally well, is damaged but keeps no original: it
enters the table as a form without one.

Covered chains: every encoding of ``CODECS`` alone, every two of them of which one is in ``REPEATED``, and those in
``REPEATED`` up to ``MAX_LAYERS`` times. Bytes stripped to seven bits give words of ASCII letters, which nothing tells
from clean ones; they are not found.

Defined results: null words, null arrays and empty words are not damaged; a word of any length is
handled whole; a word delivered twice is reported once; records with a null identifier are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatlas.session import ship

#: Encodings that UTF-8 bytes are taken for, most usual first.
CODECS = ("cp1252", "latin-1", "iso8859-15", "cp437", "cp850", "mac_roman", "cp1251")

#: Encodings that do so several times over.
REPEATED = ("cp1252", "latin-1")
MAX_LAYERS = 3

#: Characters of forms that are handed on at once, about.
CHUNK = 1 << 23

LOST = "�"

#: A question mark in the place of a lost letter.
QUESTION = re.compile(r"\?[^\W\d_]")

#: Ranges whose characters may stand in an original: letters of living scripts (without ligatures, phonetic and
#: outdated letters, which garbled capitals imitate) and typographic signs.
PLAUSIBLE = (
    (0x00A1, 0x00FF), (0x0100, 0x0131), (0x0134, 0x0137), (0x0139, 0x013E), (0x0141, 0x0148), (0x014C, 0x0165), (0x0168, 0x017E), (0x0218, 0x021B), (0x0386, 0x03CE), (0x0400, 0x045F), (0x0490, 0x0491),
    (0x05D0, 0x05EA), (0x0620, 0x064A), (0x0905, 0x0939), (0x0E01, 0x0E30), (0x1E80, 0x1E85), (0x1EA0, 0x1EF9),
    (0x2010, 0x2015), (0x2018, 0x201E), (0x2020, 0x2022), (0x2026, 0x2026), (0x2030, 0x2033), (0x2039, 0x203A),
    (0x20A0, 0x20BF), (0x2100, 0x214F), (0x2150, 0x215E), (0x2190, 0x21FF), (0x2200, 0x22FF), (0x3001, 0x3011),
    (0x3041, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1FAFF),
)


@lru_cache(maxsize=16)
def codec(name: str) -> tuple[list[str], dict[str, int]]:
    """Byte to character and back; bytes that the encoding leaves open stand for themselves."""
    table = []
    for byte in range(256):
        try:
            table.append(bytes([byte]).decode(name))
        except UnicodeDecodeError:
            table.append(chr(byte))
    return table, {c: b for b, c in enumerate(table)}


@lru_cache(maxsize=16)
def reader(name: str) -> str:
    """The characters of all bytes in the encoding ``name``, in order."""
    return "".join(codec(name)[0])


def garble(word: str, name: str) -> str:
    """The UTF-8 bytes of ``word`` read in the encoding ``name``."""
    return word.encode("utf-8", "replace").decode("latin-1").translate(reader(name))


def ungarble(word: str, name: str) -> str | None:
    """The text whose UTF-8 bytes, read in ``name``, are ``word``; None if there is none."""
    _, back = codec(name)
    try:
        text = bytes(back[c] for c in word).decode("utf-8")
    except (KeyError, UnicodeDecodeError):
        return None
    return None if text == word else text


def lossy(word: str) -> Iterator[tuple[str, str]]:
    """Forms of a word whose bytes beyond ASCII were lost, by how they were lost."""
    question = "".join(c if c < "\x80" else "?" for c in word)
    if QUESTION.search(question):
        yield "lost:question", question
    yield "lost:character", "".join(c if c < "\x80" else LOST for c in word)
    yield "lost:byte", "".join(c if c < "\x80" else LOST * len(c.encode("utf-8", "replace")) for c in word)
    open_bytes = {i for i in range(256) if codec("cp1252")[0][i] == chr(i) and 0x80 <= i < 0xA0}
    data = word.encode("utf-8", "replace")
    if any(b in open_bytes for b in data):
        table, _ = codec("cp1252")
        yield "lost:cp1252", "".join(LOST if b in open_bytes else table[b] for b in data)


def forms(word: str) -> dict[str, str]:
    """Every garbled form of an original with the chain that makes it."""
    found: dict[str, str] = {}
    layer = [((name,), garble(word, name)) for name in CODECS]
    for depth in range(1, MAX_LAYERS + 1):
        for chain, form in layer:
            found.setdefault(form, ">".join(chain))
        further = lambda chain: tuple(c for c in CODECS if following(chain, c))
        layer = [((*chain, name), garble(form, name)) for chain, form in layer for name in further(chain)] if depth < MAX_LAYERS else []
    for chain, form in lossy(word):
        found.setdefault(form, chain)
    for form, chain in list(found.items()):
        for how, changed in (("lower", form.lower()), ("upper", form.upper())):
            found.setdefault(changed, f"{chain}>{how}")
    for same in (word, word.lower(), word.upper()):
        found.pop(same, None)
    return found


def following(chain: tuple[str, ...], name: str) -> bool:
    """Whether a text garbled along ``chain`` may be garbled by ``name`` too."""
    if name in REPEATED and all(c in REPEATED for c in chain):
        return True
    return len(chain) == 1 and (name in REPEATED or chain[0] in REPEATED)


def script_of(point: int) -> str:
    """The script of a letter, by block."""
    if point < 0x250 or 0x1E00 <= point < 0x1F00:
        return "latin"
    return "greek" if point < 0x400 else "cyrillic" if point < 0x530 else "east" if point >= 0x3000 else f"block {point >> 7}"


def plausible(word: str) -> bool:
    """Whether a decoded word may be an original: living scripts only, and one script in a run of letters."""
    script = ""
    for c in word:
        point = ord(c)
        if point < 0x80:
            if point < 0x20 or point == 0x7F:
                return False
        elif not any(a <= point <= b for a, b in PLAUSIBLE):
            return False
        if c.isalpha():
            kind = script_of(point)
            if script and kind != script:
                return False
            script = kind
        else:
            script = ""
    return True


#: Signs that count as letters and are second characters of garbled letters.
LETTER_SIGNS = "ªµº"


def capitals_of_leads(word: str) -> Iterator[str]:
    """Words that give ``word`` in lower case, with capitals where a sequence of bytes may begin."""
    _, back = codec("cp1252")
    letters = list(word)
    for i, c in enumerate(letters[:-1]):
        lead = back.get(c.upper(), 0) if len(c.upper()) == 1 else 0
        after = back.get(letters[i + 1], 0)
        if 0xC2 <= lead < 0xF5 and (0x80 <= after < 0xC0 or letters[i + 1] in "šœžÿ"):
            letters[i] = c.upper()
    changed = "".join(letters)
    if changed != word:
        yield changed
        for small in "šœžÿ":
            if small in changed:
                yield changed.replace(small, small.upper())


def originals(word: str) -> dict[str, str]:
    """Plausible texts that a chain may have garbled into the word, with that chain."""
    found: dict[str, str] = {}

    def follow(text: str, chain: tuple[str, ...], after: str) -> bool:
        deeper = False
        for name in CODECS:
            # reading on inwards, the chain so far lies outside of ``name``
            if chain and (len(chain) == MAX_LAYERS or not following((name,), chain[0]) or not all(c in REPEATED for c in chain[1:])):
                continue
            before = ungarble(text, name)
            if before is not None:
                inner = (name, *chain)
                if not follow(before, inner, after) and plausible(before):
                    found.setdefault(before, ">".join((*inner, after) if after else inner))
                deeper = deeper or bool(found)
        return deeper

    if follow(word, (), ""):
        return found
    if all(c < "\x80" or c.isalpha() and c not in LETTER_SIGNS for c in word):
        return {}  # letters alone may be a clean word in lower case
    for changed in capitals_of_leads(word):
        if follow(changed, (), "lower") or found:
            break
    return {o: chain for o, chain in found.items() if o.lower() != word}


def proposed(words: DataFrame) -> DataFrame:
    """``(original, known, weight)`` from the distinct words ``(word, n)``: clean words, known, with their number, and
    what other words decode to. A null original stands for each word whose bytes are lost, in ``form``."""
    ship(words.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str | None, str | None, bool, int]] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if LOST in word:
                    rows.append((None, word, False, 0))
                    continue
                decoded = originals(word)
                rows += [(original, None, False, 0) for original in decoded] or [(word, None, True, n)]
            columns = list(zip(*rows)) or [()] * 4
            types = (pa.string(), pa.string(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["original", "form", "known", "weight"])

    found = over_all_tasks(words, "word").mapInArrow(kernel, "original string, form string, known boolean, weight long")
    return found.groupBy("original", "form").agg(F.max("known").alias("known"), F.sum("weight").alias("weight"))


def over_all_tasks(df: DataFrame, column: str) -> DataFrame:
    """Spread rows over all tasks: by a hash of the hash, as the rows lie by that of the column already, and by a fixed
    number, which keeps their few bytes from being coalesced into one slow task."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, F.xxhash64(column))


def form_table(words: DataFrame) -> DataFrame:
    """``(form, original, chain, known, weight)`` from the distinct words ``(word, n)``.

    ``known`` tells whether the original stands in the corpus, ``weight`` how often.
    """
    ship(words.sparkSession)
    schema = "form string, original string, chain string, known boolean, weight long"
    names = ["form", "original", "chain", "known", "weight"]
    types = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str | None, str, bool, int]] = []
        size = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for original, lost, known, n in zip(*(c.to_pylist() for c in batch.columns)):
                if original is None:
                    rows.append((lost, None, "lost", False, 0))
                else:
                    rows += [(form, original, chain, known, n) for form, chain in forms(original).items()]
                    size += 200 * len(original)
                if size >= CHUNK:  # forms of a few long words fill a batch as many short ones do
                    yield made()
                    rows, size = [], 0
        if rows:
            yield made()

    return over_all_tasks(proposed(words), "original").mapInArrow(kernel, schema)


def may_be_garbled(column: F.Column) -> F.Column:
    """Whether a text has a character beyond ASCII or a question mark before a letter."""
    return (F.octet_length(column) > F.char_length(column)) | column.rlike(r"\?\p{L}")


def example_words(examples: DataFrame) -> DataFrame:
    """The words that may be garbled of word-level examples."""
    some = examples.where(F.col("example_id").isNotNull() & may_be_garbled(F.array_join("words", " ")))
    return some.select("example_id", F.posexplode("words").alias("word_pos", "word")).where(may_be_garbled(F.col("word"))).select(
        F.lit("srl_examples").alias("table_name"), F.col("example_id").alias("record_id"), "word_pos", "word"
    )


def terminal_words(terminals: DataFrame) -> DataFrame:
    """The words that may be garbled of tree leaves."""
    return terminals.where(may_be_garbled(F.col("word"))).select(
        F.lit("penn_terminals").alias("table_name"),
        F.concat_ws(":", F.col("document_id"), F.col("sentence_index").cast("string")).alias("record_id"),
        F.col("terminal_index").cast("int").alias("word_pos"),
        "word",
    ).where(F.col("word_pos").isNotNull() & F.col("record_id").contains(":"))


def damaged_words(words: DataFrame) -> DataFrame:
    """``(word, restored, chain)`` of every damaged distinct word of ``(word, n)``.

    ``restored`` is the verified original: one found in the corpus before one that is only decoded, and
    of several the most frequent one of the corpus. Where bytes were lost, only the sole original of the
    corpus that fits is put back, else null.
    """
    # a semi-join can broadcast the stored words only: Spark takes the forms for as many as the originals, some thirty times too few
    hits = form_table(words).join(words.select(F.col("word").alias("form")), "form", "left_semi").withColumnRenamed("form", "word")
    score = F.struct(
        F.when(F.col("original").isNull(), 2).when(F.col("known"), 0).otherwise(1).alias("kind"),
        F.when(F.col("chain").startswith("lost"), 0).otherwise(-F.col("weight")).alias("weight"),
    )
    chosen = F.min(F.struct(F.length("chain").alias("size"), "chain", "original"))
    sure = (F.min("original") == F.max("original")) | ~F.max(F.col("chain").startswith("lost"))
    ranked = hits.withColumn("score", score).groupBy("word", "score").agg(chosen.alias("c"), sure.alias("sure"))
    return ranked.groupBy("word").agg(F.min(F.struct("score", "c", "sure")).alias("best")).select(
        "word", F.when(F.col("best.sure"), F.col("best.c.original")).alias("restored"), F.col("best.c.chain").alias("chain")
    )


def restore(examples: DataFrame, terminals: DataFrame) -> DataFrame:
    """``(table_name, record_id, word_pos, word, restored, chain)``: every damaged word of both tables, once."""
    occurrences = example_words(examples).unionByName(terminal_words(terminals))
    words = occurrences.groupBy("word").agg(F.count("*").alias("n"))
    return occurrences.join(damaged_words(words), "word").select(
        "table_name", "record_id", "word_pos", "word", "restored", "chain"
    ).distinct()
