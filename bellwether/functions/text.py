"""Tokens and company-name cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"

# Legal-form words that carry no name.
LEGAL_FORMS = (
    "inc", "llc", "ltd", "corp", "corporation", "company", "co", "plc", "holdings",
    "technologies", "international", "group",
)

# Words of a question that never name a company.
QUESTION_FILLERS = (
    "stock", "stocks", "company", "companies", "sector", "market", "tomorrow", "growth",
    "prediction", "about", "for", "show", "me", "what", "is", "the", "of", "will", "grow",
)

# The English stop words that Spark ML ships
# (StopWordsRemover.loadDefaultStopWords("english")).
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below
to from up down in out on off over under again further then once here there when
where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now i'll you'll he'll she'll
we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're
they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't
hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't
cannot could here's how's let's ought that's there's what's when's where's who's
why's would
""".split()


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscore."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}+"), F.lit(0))


def space_tokens(text: Column) -> Column:
    """Lower-cased pieces between white space, punctuation kept."""
    pieces = F.split(F.lower(text), r"(?U)\s+")
    return F.filter(pieces, lambda piece: piece != "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_company_name(name: Column) -> Column:
    """Lower case, punctuation to space, legal forms dropped, spaces squeezed."""
    spaced = F.regexp_replace(F.lower(name), rf"(?U)[^{WORD[1:-1]}\s]", " ")
    bare = F.regexp_replace(
        spaced, rf"(?<!{WORD})({'|'.join(LEGAL_FORMS)})(?!{WORD})", ""
    )
    return F.coalesce(squeeze(bare), F.lit(""))


def strip_inc(name: Column) -> Column:
    return F.trim(F.replace(name, F.lit("Inc."), F.lit("")))


def join_headline_text(headline: Column, text: Column) -> Column:
    return F.concat_ws(" ", headline, text)


def word_bounded(literal: Column) -> Column:
    """Regular expression that finds a literal between word edges."""
    quoted = F.replace(literal, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("(?U)\\b\\Q"), quoted, F.lit("\\E\\b"))


def whole_word(name: Column) -> Column:
    """The same for a lower-cased name."""
    return word_bounded(F.lower(name))
