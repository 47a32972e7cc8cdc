
from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark import constants as C

BLANK = " \t\n\x0b\x0c\r"


def strip(text: Column) -> Column:
    """Without white space at both ends (``trim`` alone takes spaces only)."""
    return F.btrim(text, F.lit(BLANK))


def token_estimate(text: Column) -> Column:
    """A fourth of the characters, half to even, one at least."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / C.CHARS_PER_TOKEN, 0).cast("int"))


def non_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentences(text: Column) -> Column:
    """After . ! ? and white space, and after line breaks; trimmed, blanks dropped."""
    return non_blank(F.split(text, C.SENTENCE_BREAK, -1))


def split_long(text: Column, size: int, overlap: int, sep: str = " ") -> Column:
    """Greedy pieces of at most ``4 * size`` characters; each begins with the last units of the one before."""
    most = size * C.CHARS_PER_TOKEN
    carried = max(1, (overlap * 4) // max(1, len(sep) + 8)) if overlap else 0
    empty = F.struct(
        F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n")
    )

    def step(s: Column, unit: Column) -> Column:
        add = F.length(unit) + len(sep)
        full = (F.size(s["cur"]) > 0) & (s["n"] + add > most)
        tail = (
            F.slice(s["cur"], F.greatest(F.lit(1), F.size(s["cur"]) - (carried - 1)), F.lit(carried))
            if carried
            else F.array().cast("array<string>")
        )
        width = F.aggregate(tail, F.lit(0), lambda a, x: a + F.length(x) + len(sep))
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(F.array_join(s["cur"], sep)))).otherwise(s["done"]).alias("done"),
            F.concat(F.when(full, tail).otherwise(s["cur"]), F.array(unit)).alias("cur"),
            (F.when(full, width).otherwise(s["n"]) + add).alias("n"),
        )

    folded = F.aggregate(
        F.split(text, sep.replace(" ", "[ ]"), -1),
        empty,
        step,
        lambda s: F.when(F.size(s["cur"]) > 0, F.concat(s["done"], F.array(F.array_join(s["cur"], sep)))).otherwise(s["done"]),
    )
    short = F.length(text) <= most
    return F.when(short, non_blank(F.array(text))).otherwise(non_blank(folded))


def whole(text: Column) -> Column:
    return non_blank(F.array(text))


def _or_whole(parts: Column, text: Column, fn) -> Column:
    return F.when(F.size(parts) > 0, F.flatten(F.transform(parts, fn))).otherwise(whole(text))


def chunk_sentence(text: Column, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, cut: bool = True) -> Column:
    """A chunk per sentence; one that exceeds the budget is cut by words, or stays whole without ``cut``."""

    def one(s: Column) -> Column:
        return F.when(token_estimate(s) > size, split_long(s, size, overlap)).otherwise(F.array(s))

    return _or_whole(sentences(text), text, one if cut else lambda s: F.array(s))


def chunk_paragraph(text: Column, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, cut: bool = True) -> Column:
    """T4: a chunk per paragraph; one that exceeds the budget is cut by sentence (``cut``: as in ``chunk_sentence``)."""

    def one(p: Column) -> Column:
        return F.when(token_estimate(p) > size, chunk_sentence(p, size, overlap, cut)).otherwise(F.array(p))

    return _or_whole(non_blank(F.split(text, C.PARAGRAPH_BREAK, -1)), text, one)


def chunk_section(text: Column, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP, keep_preamble: bool = False, cut: bool = True) -> Column:
    """T5: a chunk per header and its body. Text before the first header is dropped unless ``keep_preamble``; ``cut`` is as
    in ``chunk_sentence``."""
    blocks = F.split(text, r"(?m)(?=^#{1,6}\s+.*$)", -1)
    headed = F.filter(non_blank(blocks), lambda b: F.regexp_like(b, F.lit(r"^#{1,6}\s+[\s\S]*")))

    def one(block: Column) -> Column:
        header = strip(F.regexp_extract(block, C.HEADER, 1))
        body = strip(F.substr(block, F.length(header) + 1))
        pieces = F.transform(chunk_sentence(body, size, overlap, cut), lambda s: F.concat(header, F.lit("\n\n"), s))
        return F.when(token_estimate(block) > size, pieces).otherwise(F.array(block))

    parts = F.flatten(F.transform(headed, one))
    if keep_preamble:
        before = F.filter(non_blank(F.slice(blocks, 1, 1)), lambda b: ~F.regexp_like(b, F.lit(r"^#{1,6}\s+[\s\S]*")))
        parts = F.concat(F.flatten(F.transform(before, lambda b: chunk_paragraph(b, size, overlap, cut))), parts)
    return F.when(F.size(headed) > 0, parts).otherwise(chunk_paragraph(text, size, overlap, cut))


def chunk_fixed(text: Column, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> Column:
    """Windows of ``4 * size`` characters, stepping by size less overlap; it stops when one reaches the end."""
    width, step = max(1, size * 4), max(1, (size - overlap) * 4)
    n = F.length(text)
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: (i == 0) | (i - step + width < n)
    )
    return non_blank(F.transform(starts, lambda i: F.substr(text, i + 1, F.lit(width))))


def chunk_words(text: Column, width: int = C.WORD_WINDOW, step: int = C.WORD_STEP) -> Column:
    """Windows of words; the last is the one that reaches the end."""
    words = F.filter(F.split(text, r"\s+", -1), lambda w: w != "")
    n = F.size(words)
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: (i == 0) | (i - step + width < n)
    )
    cut = F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(width)), " "))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


STRATEGIES = {
    "sentence": chunk_sentence,
    "paragraph": chunk_paragraph,
    "section": chunk_section,
    "fixed": chunk_fixed,
}


def chunk(text: Column, strategy: str = "sentence", size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP) -> Column:
    """By name; an unknown name cuts by sentence, ``none`` not at all."""
    if strategy == "none":
        return whole(text)
    return STRATEGIES.get(strategy, chunk_sentence)(text, size, overlap)


def windows_of_sentences(text: Column, most: int = C.LLM_WINDOW_WORDS, overlap: int = C.LLM_WINDOW_OVERLAP) -> Column:
    """Windows of whole sentences that reach ``most`` words, overlapping by ``overlap`` sentences; the next window
    begins after the last where going back would be no progress. Each depends on the one before: a pandas UDF."""

    @F.pandas_udf("array<string>")
    def cut(sents: pd.Series) -> pd.Series:
        def one(s: list[str] | None) -> list[str]:
            s = [] if s is None else list(s)
            n, out, start = [len(x.split()) for x in s], [], 0
            while start < len(s):
                end, total = start, 0
                while end < len(s) and (total < most or end == start):
                    total += n[end]
                    end += 1
                out.append(" ".join(s[start:end]))
                if end == len(s):
                    break
                start = end - overlap if end - overlap > start else end
            return out

        return sents.map(one)

    return cut(sentences(text))


def tokens(text: Column) -> Column:
    """Lower-cased Unicode words."""
    return F.regexp_extract_all(F.lower(text), F.lit(C.WORD), F.lit(0))


def long_tokens(text: Column) -> Column:
    """Words of two characters or more, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def latin_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(C.LATIN_WORD), F.lit(0))


def sparse_bin(token: Column) -> Column:
    """A2: the first two bytes of the md5, low byte first; 65536 bins."""
    m = F.md5(token)
    return F.conv(F.concat(F.substring(m, 3, 2), F.substring(m, 1, 2)), 16, 10).cast("int")


def content_terms(text: Column, stopwords: list[str] = C.ANSWER_STOPWORDS) -> Column:
    """Distinct tokens that are no stopwords."""
    return F.array_except(F.array_distinct(tokens(text)), F.array(*map(F.lit, stopwords)))


def keywords(text: Column) -> Column:
    """Between 'and', commas and semicolons; longer than two characters."""
    parts = F.transform(F.split(F.lower(text), C.KEYWORD_BREAK, -1), strip)
    return F.filter(parts, lambda p: F.length(p) >= C.KEYWORD_MIN)


def account_id(text: Column) -> Column:
    """Null where none is named."""
    return F.nullif(F.regexp_extract(F.lower(text), C.ACCOUNT, 1), F.lit(""))


def route(query: Column) -> Column:
    """T14, T15: 'graph' for id look-ups and short factual questions, else 'hybrid'."""
    words = F.size(F.filter(F.split(query, r"\s+", -1), lambda w: w != ""))
    short = query.rlike(C.FACTUAL_LEAD) & ~query.rlike(C.ANALYTICAL) & (words <= C.FACTUAL_MAX_WORDS)
    return F.when(query.rlike(C.ID_TOKEN) | short, "graph").otherwise("hybrid")


def rewrite(query: Column) -> Column:
    """The tokens that are no stopwords, in order; the query itself where none is left."""
    stop = F.array(*map(F.lit, C.QUESTION_STOPWORDS))
    kept = F.filter(tokens(query), lambda t: ~F.array_contains(stop, t))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(query)


def _untagged(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(C.CANDIDATE_TAG), F.lit("")), F.lit(C.PROSE_TAG), F.lit(""))


def normal_name(text: Column) -> Column:
    """The title a candidate is compared by."""
    line = F.split_part(strip(_untagged(text)), F.lit("\n"), F.lit(1))
    return F.lower(strip(F.split_part(line, F.lit(C.CODE_TAG), F.lit(1))))


def display_name(text: Column) -> Column:
    line = F.split_part(_untagged(text), F.lit("\n"), F.lit(1))
    return F.left(strip(F.split_part(line, F.lit(C.CODE_TAG), F.lit(1))), F.lit(120))


def entity_name(name: Column) -> Column:
    """Without quotes and punctuation at its end."""
    return strip(F.regexp_replace(strip(name), C.NAME_END, ""))


def relation_type(name: Column) -> Column:
    """Upper case, other than letters, digits and _ become _; REL_ where it starts otherwise."""
    safe = F.regexp_replace(F.upper(F.coalesce(name, F.lit("ASSOCIATED_WITH"))), r"[^\p{L}\p{N}_]", "_")
    return F.when(safe.rlike(r"^[\p{L}_]"), safe).otherwise(F.concat(F.lit("REL_"), safe))


def graph_label(name: Column) -> Column:
    """Null where the label can't start a name."""
    safe = F.regexp_replace(name, r"[^\p{L}\p{N}_]", "_")
    return F.when(safe.rlike(r"^[\p{L}_]"), safe)


def checksum(text: Column) -> Column:
    """T26."""
    return F.sha2(text, 256)


def article_id(title: Column) -> Column:
    """T27."""
    return F.concat(F.lit("wiki:"), F.left(F.md5(title), F.lit(12)))


def article_url(title: Column, base: str) -> Column:
    """T28."""
    return F.concat(F.lit(base), F.replace(title, F.lit(" "), F.lit("_")))


def eval_sentences(text: Column) -> Column:
    """Sentences with the dots of common abbreviations kept."""
    kept = F.regexp_replace(strip(text), C.ABBREVIATION, "$1<DOT>")
    parts = F.filter(F.split(kept, r"(?<=[.!?])\s+", -1), lambda s: strip(s) != "")
    return F.transform(parts, lambda s: F.replace(s, F.lit("<DOT>"), F.lit(".")))


def first_words(text: Column, start: int, end: int) -> Column:
    words = F.filter(F.split(text, r"\s+", -1), lambda w: w != "")
    return F.array_join(F.slice(words, start + 1, end - start), " ")


def golden_truth(text: Column) -> Column:
    """Words 4 to 14, or the first 18 where that is under 20 characters."""
    ends = F.lit(" .,;:")
    span = F.btrim(first_words(text, 3, 14), ends)
    return F.when(F.length(span) < 20, F.btrim(first_words(text, 0, 18), ends)).otherwise(span)


def golden_question(doc_id: Column) -> Column:
    last = F.replace(F.element_at(F.split(doc_id, "::", -1), -1), F.lit("-"), F.lit(" "))
    return F.concat(F.lit("what does the "), last, F.lit(" document describe?"))


def plausible_entity(name: Column) -> Column:
    """short, without a relation verb; several words (three at most) start with a capital."""
    s = strip(F.coalesce(name, F.lit("")))
    verb = reduce(lambda a, b: a | b, (F.contains(F.lower(s), F.lit(v)) for v in C.RELATION_FRAGMENTS))
    n = F.size(F.filter(F.split(s, r"\s+", -1), lambda w: w != ""))
    capital = s.rlike(r"^\p{Lu}")
    return (s != "") & (F.length(s) <= 80) & ~verb & ((n == 1) | ((n <= 3) & capital))


def profile_text(entity: Column, text: Column, window: int = 2) -> Column:
    """The sentence that names the entity with its neighbours; else the first with a word of it; else ''."""
    sents = sentences(text)
    low = F.transform(sents, F.lower)
    at = F.array_position(F.transform(low, lambda s: F.contains(s, F.lower(entity))), F.lit(True)).cast("int")
    start = F.greatest(at - window, F.lit(1))
    around = F.array_join(F.slice(sents, start, at + window + 1 - start), " ")
    words = F.filter(F.split(entity, r"\s+", -1), lambda w: w != "")
    by_word = F.flatten(
        F.transform(words, lambda w: F.filter(sents, lambda s: F.contains(F.lower(s), F.lower(w))))
    )
    fallback = F.left(F.coalesce(F.try_element_at(by_word, F.lit(1)), F.lit("")), F.lit(300))
    return F.when(at > 0, F.left(around, F.lit(C.PROMPT_CHARS))).otherwise(fallback)


def confidence(score: Column) -> Column:
    """M4."""
    return F.when(score >= C.CONFIDENCE_HIGH, "high").when(score >= C.CONFIDENCE_MEDIUM, "medium").otherwise("low")


def infer_domain(path: Column) -> Column:
    """pdf first, then the first folder marker that the path contains, in order."""
    low = F.lower(path)
    out = F.when(low.endswith(".pdf"), "journal")
    for marker, domain in C.FOLDER_DOMAINS:
        out = out.when(F.contains(low, F.lit(marker)), domain)
    return out.otherwise(C.DEFAULT_DOMAIN)


def numbered(contexts: Column) -> Column:
    """W2: '[n] text'."""
    return F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c))


EDGE_FRAMING = (
    'Some contexts are relationships, written as "GRAPH EDGE: A -[RELATIONSHIP]-> B". Each says that A relates to B. '
    "Relationships chain: A to B and B to C make A relate to C. Use them for questions about indirect links.\n\n"
)


def synthesis_prompt(query: Column, contexts: Column, role: str = "knowledge assistant", template: str | None = None) -> Column:
    """Numbered contexts and the question, in a given template or the general one, cut to the budget."""
    ctx = F.array_join(numbered(contexts), "\n\n")
    if template and "{context}" in template and "{query}" in template:
        text = F.replace(F.replace(F.lit(template), F.lit("{context}"), ctx), F.lit("{query}"), query)
        return F.left(text, F.lit(C.PROMPT_CHARS))
    base = F.concat(
        F.lit(C.SYNTHESIS_HEAD.replace("{role}", role)), ctx, F.lit(C.SYNTHESIS_QUESTION), query,
    )
    edges = F.exists(contexts, lambda c: F.contains(c, F.lit(C.EDGE_TAG)))
    return F.left(F.when(edges, F.concat(F.lit(EDGE_FRAMING), base)).otherwise(base), F.lit(C.PROMPT_CHARS))


def extraction_prompt(template: str, doc_id: Column, text: Column, entity_types: list[str], relation_types: list[str]) -> Column:
    """Tokens of the template replaced, the text cut to the budget."""
    out = F.replace(F.lit(template), F.lit("{doc_id}"), doc_id)
    out = F.replace(out, F.lit("{entity_types}"), F.lit(", ".join(entity_types)))
    out = F.replace(out, F.lit("{relation_types}"), F.lit(", ".join(relation_types)))
    return F.replace(out, F.lit("{text}"), F.left(text, F.lit(C.EXTRACTION_CHARS)))


def window_prompt(window: Column, summary: Column, entities: Column, relation_types: list[str]) -> Column:
    """Sections joined by a blank line; a null or empty summary has no section."""
    return F.concat_ws(
        "\n\n",
        F.when(F.coalesce(summary, F.lit("")) != "", F.concat(F.lit("PREVIOUS WINDOW SUMMARY:\n"), summary)),
        F.concat(F.lit("CURRENT WINDOW:\n"), window),
        F.concat(F.lit("PRE-DETECTED ENTITIES:\n"), F.array_join(F.transform(entities, lambda e: F.concat(F.lit("- "), e)), "\n")),
        F.lit("RELATION TYPES: " + ", ".join(relation_types)),
    )


def metadata_warnings(metadata: Column, allowed: list[str], domain: str) -> Column:
    """a message for each key the schema lacks; no schema accepts all."""
    if not allowed:
        return F.array().cast("array<string>")
    unknown = F.array_sort(F.array_except(F.map_keys(metadata), F.array(*map(F.lit, allowed))))
    return F.transform(
        F.coalesce(unknown, F.array().cast("array<string>")),
        lambda k: F.replace(F.lit(C.METADATA_WARNING.replace("{domain}", domain)), F.lit("{key}"), k),
    )
