"""Review text: tokens, stop words, keyword flag. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default English stop words of Spark's StopWordsRemover, in its order.
ENGLISH_STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
    her hers herself it its itself they them their theirs themselves what which who whom this that
    these those am is are was were be been being have has had having do does did doing a an the and
    but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here
    there when where why how all any both each few more most other some such no nor not only own
    same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll
    i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
    they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
    shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
    what's when's where's who's why's would
    """.split()
)

# What the token pattern \s matches.
_BLANKS = " \t\n\x0b\f\r"


def _without_trailing_blanks(text: Column) -> Column:
    return F.rtrim(F.lower(text), F.lit(_BLANKS))


def tokens(text: Column) -> Column:
    """Lower-cased text cut at every single blank; inner empty tokens stay, trailing ones go."""
    only_blanks = (_without_trailing_blanks(text) == "") & (text != "")
    return F.when(only_blanks, F.array().cast("array<string>")).otherwise(
        F.split(_without_trailing_blanks(text), r"\s", -1)
    )


def without_stop_words(words: Column, stop_words: tuple[str, ...] = ENGLISH_STOP_WORDS) -> Column:
    """The words that are not stop words, in order, repeats kept."""
    return F.filter(words, lambda word: ~word.isin(*stop_words))


def clean_text(text: Column) -> Column:
    """Remaining words joined by one space; a NULL text gives an empty string."""
    words = F.split(_without_trailing_blanks(text), r"\s", -1)
    return F.concat_ws(" ", without_stop_words(words))


def mentions(text: Column, keyword: str) -> Column:
    """1 when the clean text holds ``keyword`` as a substring, else 0 (0 for a NULL text).

    A keyword without blanks always lies within one token. If it is also part of no stop word, no
    token that holds it is ever removed, so the lower-cased text itself gives the same answer and
    the token array need not be built.
    """
    within_one_token = bool(keyword) and not any(c.isspace() for c in keyword)
    touches_stop_word = any(keyword in word for word in ENGLISH_STOP_WORDS)
    searched = F.lower(text) if within_one_token and not touches_stop_word else clean_text(text)
    return F.when(searched.contains(keyword), 1).otherwise(0)
