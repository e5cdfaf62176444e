"""Word lists and patterns of the text functions."""

from __future__ import annotations

# The 33 English stop words of the Lucene analyzers.
LIBRARY_STOP_WORDS = """
a an and are as at be but by for if in into is it no not of on or such that the their then there
these they this to was will with
""".split()

# The custom list of symbols and words removed from short posts. "ours " with a blank at
# its end is part of the list, so the word "ours" stays.
CUSTOM_STOP_WORDS = """
? (>_<) >_< à + % [ ] | ‘ ’ ♥ !! ?! ?? !? , ` `` '' -lrb- -rrb- -lsb- -rsb- . : ; " ' < > { } - (
) & $ @ ! ^ # * .. ... 'll 's 'm ###
a about above after again all am an and any are arent as at be because been before being below
between both but by can can't cannot cant could couldn't couldnt did didn't didnt do does doesn't
doesnt doing don't dont down during each favorite few flash-mob for from further had hadn't hadnt
has hasn't hasnt have haven't havent having he he'd he'll he's her here here's heres hers herself
hes him himself his how how's hows i i'd i'll i'm i've if im in into is isn't isnt it it's its
itself let's lets me more most mustnt my myself no nor not of off on once only or other ought our
ourselves out over own please return retweet rt rt. same shan't shant she she'd she'll she's shes
should shouldn't shouldnt so some such than that that's thats the their theirs them themselves
then there there's theres these they they'd they'll they're they've theyll theyre theyve this
those through to too tweet twitter under until up very via video vìa vía was wasn't wasnt we we'd
we'll we're we've were weren't werent what what's whats when when's whens where where's wheres
which while who who's whom whos why why's whys with won't wont would wouldn't wouldnt you you'd
you'll you're you've youd youll your youre yours yourself yourselves youtube youve
""".split() + ["ours "]

# Words added by the second list, which is about one kind of event.
FLASH_MOB_WORDS = "flash mob flashmob flashmobs".split()


def stop_words(flash_mob: bool = False) -> list[str]:
    """Both stop lists in one; ``flash_mob`` picks the longer custom list."""
    extra = FLASH_MOB_WORDS if flash_mob else []
    return list(dict.fromkeys(LIBRARY_STOP_WORDS + CUSTOM_STOP_WORDS + extra))


# Word characters and the characters that may join two of them inside one token.
LETTER = r"\p{L}"
ALNUM = r"\p{L}\p{M}\p{N}"
LETTER_JOINERS = "'’.:·‧"
DIGIT_JOINERS = "'’.,;"

# Length bounds of a term.
MIN_TERM = 3
MAX_TERM = 50

# A group of letters repeated three times or more.
ELONGATED = r"([a-zA-Z]+)\1{2,}"

# Where a tag in camel case is cut, without and with digits.
CAMEL_LETTERS = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
CAMEL_DIGITS = r"(?<!(^|[A-Z0-9]))(?=[A-Z0-9])|(?<!d^)(?=[A-Z][a-z])"

# Emoticons, and what may stand around them.
SMILEY = r":[)DdpPSsoO]+|:[ -]\)|<3+"
FROWNY = r":[(<]|:[ -]\("
EMOTICON_SPACE = r"[\p{C}\p{Z}&&[^\n\r\p{Cs}]]"
EMOTICON_MARK = r"[\p{P}\p{M}\p{S}\n\r]"
EMOTICON = (
    rf"(?<=^|{EMOTICON_SPACE}|{EMOTICON_MARK})({SMILEY}|{FROWNY})+"
    rf"(?=$|{EMOTICON_SPACE}|{EMOTICON_MARK})"
)

# Part-of-speech tags of punctuation and function words.
UNWANTED_TAGS = """
HT USR CC LRB RRB POS PRP UH WDT WP WP$ WRB $ # ( ) { } | . , : '' `` > SYM
""".split()

# Tags of proper nouns and their weight.
PROPER_NOUN_TAGS = ["NNP", "NNPS"]
PROPER_NOUN_WEIGHT = 1.5
