"""Column functions over text: tokens, folded words with offsets, windows, identifiers, references.

All offsets are half-open and count Unicode code points, as ``length`` and ``substring`` do. Nothing
here leaves the JVM.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in a window, and the least words of a shared run.
WINDOW = 8
#: A number with inner points or commas and a per cent sign, else a run of letters, digits and underscores.
TOKEN = r"\p{Nd}+(?:[.,]\p{Nd}+)*%?|[\p{L}\p{N}_]+"
_ANY_TOKEN = TOKEN + r"|[^\s\p{L}\p{N}_]"
_ALNUM = r"[\p{L}\p{N}]"


def _spans(points: list[int]) -> str:
    """A character class of code points, as ranges."""
    starts = [p for p in points if p - 1 not in points]
    ends = [p for p in points if p + 1 not in points]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True)) + "]"


#: Characters that Unicode folds otherwise than it lowers them, the sharp s aside (a capital sigma is lowered by its place), and what they become once lowered.
_POINTS = [p for p in (*range(0x80, 0xD800), *range(0xE000, 0x110000)) if (chr(p).casefold() != chr(p).lower() and chr(p).lower() != "ß") or chr(p) == "Σ"]
_RARE = _spans(sorted(_POINTS)) if len(_POINTS) < 2000 else "."
_FOLDED = {c: c.casefold() for p in _POINTS for c in chr(p).lower() if c.casefold() != c}


def _fold_rare(text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in sorted(_FOLDED.items()) for x in pair])
    return F.array_join(F.transform(F.split(_fold_plain(text), ""), lambda c: F.coalesce(table[c], c)), "")


def _fold_plain(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def _is_rare(text: Column) -> Column:
    """Whether lower case and the sharp s do not make up the fold; texts of ASCII alone are not looked through."""
    return (F.octet_length(text) > F.length(text)) & F.rlike(text, F.lit(_RARE))


def fold(text: Column) -> Column:
    """Caseless form by Unicode's full case folding, so that spellings compare alike."""
    return F.when(_is_rare(text), _fold_rare(text)).otherwise(_fold_plain(text))


def tokens(text: Column) -> Column:
    """All tokens in order, symbols included."""
    return F.regexp_extract_all(text, F.lit(f"({_ANY_TOKEN})"), F.lit(1))


def words(text: Column) -> Column:
    """Folded tokens that hold a letter or digit."""
    found = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))
    kept = F.filter(found, lambda w: w.rlike(_ALNUM))
    return F.when(_is_rare(text), F.transform(kept, _fold_rare)).otherwise(F.transform(kept, _fold_plain))


def word_offsets(text: Column) -> Column:
    """array<struct<word, start, end>>: the words with their places in the text.

    The text between matches is cut out by the same pattern, so a word begins after all gaps and
    matches before it; a fold over the pairs adds them up. The fold copies the array it builds, so this is
    for short texts; ``udfs.word_offsets`` is linear.
    """
    found = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))
    pairs = F.zip_with(F.split(text, TOKEN, -1), found, lambda gap, w: F.struct(F.length(gap).alias("gap"), w.alias("w")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<word:string,start:int,end:int>>)").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + pair["gap"]
        end = begin + F.length(pair["w"])
        place = F.struct(pair["w"].alias("word"), begin.alias("start"), end.alias("end"))
        return F.when(pair["w"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(place)).alias("out")))

    kept = F.filter(F.aggregate(pairs, start, step, lambda acc: acc["out"]), lambda x: x["word"].rlike(_ALNUM))
    return F.transform(kept, lambda x: F.struct(fold(x["word"]).alias("word"), x["start"].alias("start"), x["end"].alias("end")))


def windows(word_array: Column, width: int = WINDOW, mask: Column | None = None, places: Column | None = None) -> Column:
    """array<struct<at, gram>>: every ``width`` consecutive words, joined by spaces; none in shorter arrays.

    With a ``mask`` (array<boolean>) only windows that hold a true place, with ``places`` (array<int>) only those that begin there. Words are looked up one by one,
    as a slice would copy the whole array for each window; so pass columns, not expressions.
    """
    last = F.size(word_array) - width
    places = F.sequence(F.lit(0), last) if places is None else places
    if mask is not None:
        some = lambda i: reduce(or_, [F.coalesce(F.get(mask, i + k), F.lit(False)) for k in range(width)])
        places = F.filter(places, some)
    grams = F.transform(places, lambda i: F.struct(i.alias("at"), F.concat_ws(" ", *[F.get(word_array, i + k) for k in range(width)]).alias("gram")))
    return F.when(last >= 0, grams).otherwise(F.expr("cast(array() as array<struct<at:int,gram:string>>)"))


def window_hashes(word_array: Column, width: int = WINDOW) -> Column:
    """array<int>: 32 bits of a hash of each window of ``windows``, in order."""
    last = F.size(word_array) - width
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(word_array, i + k) for k in range(width)]).bitwiseAND(0xFFFFFFFF))
    return F.when(last >= 0, hashes).otherwise(F.expr("cast(array() as array<bigint>)"))


def digest(text: Column) -> Column:
    """An identity for wording or for a place: 16 hex digits of its SHA-256."""
    return F.concat(F.lit("phrase:"), F.substring(F.sha2(text, 256), 1, 16))


def place_digest(article: Column, first: Column, end: Column) -> Column:
    return digest(F.concat_ws(":", F.lit("place"), article, first.cast("string"), end.cast("string")))


def input_hash(*parts: Column) -> Column:
    """SHA-256 over parts that each end in a NUL, so that no two lists of parts run together."""
    return F.sha2(F.concat(*[F.concat(p.cast("string").cast("binary"), F.lit("\0").cast("binary")) for p in parts]), 256)


def id_part(value: Column) -> Column:
    """The characters that every identifier, path and address accepts; null where none is left."""
    part = F.trim(F.regexp_replace(value, r"[^A-Za-z0-9._-]+", "-"), F.lit("-"))
    return F.when(part != "", part)


def document_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"doc:{kind}:"), id_part(key))


def register_actor_id(register_id: Column) -> Column:
    return F.concat(F.lit("actor:tr:"), register_id)


def mep_actor_id(member: Column) -> Column:
    return F.concat(F.lit("actor:mep:"), member.cast("string"))


def named_actor_id(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"actor:name:{kind}."), id_part(name))


def procedure_slug(procedure: Column) -> Column:
    """2021/0106(COD) as 2021-0106-COD."""
    return F.trim(F.regexp_replace(procedure, r"[^A-Za-z0-9]+", "-"), F.lit("-"))


def usable_register_id(value: Column) -> Column:
    trimmed = F.trim(value)
    return F.when(trimmed.rlike(r"^\d{6,}-\d{2}$"), trimmed)


# --- References ---------------------------------------------------------------------------

COM = r"COM\s*\(\s*(\d{4})\s*\)\s*0*(\d{1,4})"


def com_references(text: Column) -> Column:
    """Every COM reference of a text as COM(2021)206, each once, in order."""
    years, numbers = (F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(COM), F.lit(g)) for g in (1, 2))
    return F.array_distinct(F.zip_with(years, numbers, lambda y, n: F.concat(F.lit("COM("), y, F.lit(")"), n.cast("int").cast("string"))))


def com_reference(text: Column) -> Column:
    """The first one; null where there is none."""
    return F.get(com_references(text), 0)


def proposal_celex(com: Column) -> Column:
    """COM(2021)206 as 52021PC0206."""
    year, number = F.regexp_extract(com, r"^COM\((\d{4})\)(\d{1,4})$", 1), F.regexp_extract(com, r"^COM\((\d{4})\)(\d{1,4})$", 2)
    return F.when(year != "", F.concat(F.lit("5"), year, F.lit("PC"), F.lpad(number, 4, "0")))


def celex_com(celex: Column) -> Column:
    """The way back; null for other sectors and kinds."""
    year, number = F.regexp_extract(celex, r"^5(\d{4})PC(\d{4})$", 1), F.regexp_extract(celex, r"^5(\d{4})PC(\d{4})$", 2)
    return F.when(year != "", F.concat(F.lit("COM("), year, F.lit(")"), number.try_cast("int").cast("string")))


def query_kind(text: Column) -> Column:
    """struct<kind, value>: a procedure, CELEX or COM reference by its shape, normalised; anything else is a title. Null if blank."""
    procedure = r"^(\d{4})\s*/\s*(\d{1,4})([A-Z]?)\s*\(?\s*([A-Za-z]{3})\s*\)?$"
    celex = r"(?i)^(?:CELEX[:\s]*)?(\d{5}[A-Za-z]{1,2}\d{4})$"
    com = r"(?i)^COM\s*[(/]?\s*(\d{4})\s*[)/]?\s*/?\s*0*(\d{1,4})(?:\s*final)?$"

    def read(t: Column) -> Column:
        part = lambda p, g: F.regexp_extract(t, p, g)
        whole = F.concat(part(procedure, 1), F.lit("/"), F.lpad(part(procedure, 2), 4, "0"), part(procedure, 3), F.lit("("), F.upper(part(procedure, 4)), F.lit(")"))
        kind = lambda name, value: F.struct(F.lit(name).alias("kind"), value.alias("value"))
        return (
            F.when(t == "", F.lit(None))
            .when(t.rlike(procedure), kind("procedure", whole))
            .when(t.rlike(celex), kind("celex", F.upper(part(celex, 1))))
            .when(t.rlike(com), kind("com", F.concat(F.lit("COM("), part(com, 1), F.lit(")"), part(com, 2).try_cast("int").cast("string"))))
            .otherwise(kind("title", t))
        )

    # The cleaned text is bound to a name, as it is used many times.
    return F.get(F.transform(F.array(F.trim(F.regexp_replace(text, r"\s+", " "))), read), F.lit(0))


# --- Citations ----------------------------------------------------------------------------

# The wording by which a run of folded words is known as a citation of another act.
CITATION_START = (
    r"^(?:the )?(?:european parliament and of the council"
    r"|(?:commission |council )?(?:implementing |delegated )?(?:regulation|directive|decision) (?:eu |ec |eec )?[0-9]"
    r"|(?:regulation|directive|decision) (?:eu|ec|eec)\b"
    r"|official journal|oj l)"
)
CITATION_ENACTED = "of the european parliament and of the council of"
CITATION_ANYWHERE = r"\b(?:oj l|official journal|repealing (?:council |commission )?(?:directive|regulation|decision)s?)\b"
CITATION_HEAD = 14


def is_citation(run: Column) -> Column:
    """Whether a run (array of words) quotes another act: by how it begins, or by a marker anywhere."""
    head, whole = F.array_join(F.slice(run, 1, CITATION_HEAD), " "), F.array_join(run, " ")
    return head.rlike(CITATION_START) | head.contains(CITATION_ENACTED) | whole.rlike(CITATION_ANYWHERE)


# --- Names --------------------------------------------------------------------------------

# What names of the same body differ by, and words that most names carry.
LEGAL_SUFFIXES = (
    "ab", "ag", "aisbl", "aps", "as", "asbl", "bv", "corp", "ev", "gmbh", "inc", "kg", "limited", "llc", "ltd", "nv", "oy", "plc",
    "sa", "sarl", "sas", "sl", "spa", "srl", "vzw",
)
STOP_WORDS = ("the", "of", "and", "for", "european", "europe", "eu")
# Words that most titles of laws carry.
TITLE_FILLER = ("a", "act", "and", "council", "directive", "eu", "european", "for", "in", "law", "of", "on", "parliament", "proposal", "regulation", "the", "to", "union")
# Cue words for the direction of a change.
STRICTER, WEAKER = ("shall", "must", "required", "least", "minimum"), ("may", "can", "optional")


def name_tokens(name: Column) -> Column:
    """Lower-case parts of a name without legal suffixes and stop words; points and apostrophes close up."""
    cleaned = F.regexp_replace(F.regexp_replace(F.lower(name), r"[.'’]", ""), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(F.trim(cleaned), " +"), lambda t: (t != "") & ~t.isin(*LEGAL_SUFFIXES, *STOP_WORDS))


def name_key(name: Column) -> Column:
    return F.array_join(name_tokens(name), " ")


def scope_words(name: Column) -> Column:
    """How many words of a name claim all of Europe."""
    return F.regexp_count(F.lower(name), F.lit(r"\b(?:europe|european|eu)\b"))


def title_words(title: Column) -> Column:
    """The different words of a title without filler; all of them if only filler is there."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
    kept = F.array_except(found, F.array(*map(F.lit, TITLE_FILLER)))
    return F.when(F.size(kept) > 0, kept).otherwise(found)


def direction(words_of_change: Column) -> Column:
    """stricter, weaker or unknown from array<struct<operation, word>>; a tie is unknown."""
    bare = F.transform(words_of_change, lambda x: F.struct(x["operation"].alias("o"), F.trim(F.lower(x["word"]), F.lit(".,;:()'\"")).alias("w")))

    def sign(total: Column, x: Column) -> Column:
        cue = F.when(x["w"].isin(*STRICTER), 1).when(x["w"].isin(*WEAKER), -1).otherwise(0)
        return total + F.when(x["o"] == "insert", cue).otherwise(-cue)

    score = F.aggregate(bare, F.lit(0), sign)
    return F.when(score > 0, "stricter").when(score < 0, "weaker").otherwise("unknown")


# --- Display ------------------------------------------------------------------------------


def provision_label(record_id: Column) -> Column:
    """art:32024R1689:article-99-11 as Art. 99(11); recitals and annexes likewise, the rest as it is."""
    tail = F.element_at(F.split(record_id, ":"), -1)
    article = r"^article-([0-9]+[a-z]*)(?:-([0-9]+))?$"
    paragraph = F.regexp_extract(tail, article, 2)
    return (
        F.when(tail.rlike(article), F.concat(F.lit("Art. "), F.regexp_extract(tail, article, 1), F.when(paragraph != "", F.concat(F.lit("("), paragraph, F.lit(")"))).otherwise("")))
        .when(tail.rlike(r"^recital-[0-9a-z]+$"), F.concat(F.lit("Recital "), F.regexp_extract(tail, r"^recital-([0-9a-z]+)$", 1)))
        .when(tail.rlike(r"^annex-[0-9a-z]+$"), F.concat(F.lit("Annex "), F.upper(F.regexp_extract(tail, r"^annex-([0-9a-z]+)$", 1))))
        .otherwise(tail)
    )


def author_labels(names: Column, ids: Column, groups: Column) -> Column:
    """Names (ids where there are none), with the group in brackets where lists are aligned."""
    shown = F.when(F.size(names) > 0, names).otherwise(ids)
    with_group = F.zip_with(shown, groups, lambda n, g: F.when(g.isNotNull(), F.concat(n, F.lit(" ("), g, F.lit(")"))).otherwise(n))
    return F.when(F.size(shown) == F.size(groups), with_group).otherwise(shown)


def wilson(correct: Column, total: Column, z: float = 1.959963984540054) -> Column:
    """struct<low, high>: the Wilson score interval, (0, 1) without observations, with its ends pinned."""
    n, p = total.cast("double"), correct / total
    centre, spread, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    low = F.when(total == 0, 0.0).when(correct == 0, 0.0).otherwise((centre - spread) / scale)
    high = F.when(total == 0, 1.0).when(correct == total, 1.0).otherwise((centre + spread) / scale)
    return F.struct(low.alias("low"), high.alias("high"))
