"""Regular expressions and word lists.

No pattern relies on `\\w`, `\\s` or `\\b`: their Unicode coverage depends on the
regex engine. Character classes are spelled out instead.
"""

# fixed values: character classes (Unicode words and white space)
WORD = r"\p{L}\p{N}_"
SPACE = r"\t-\r\x{1C}-\x{20}\x{85}\p{Z}"
SPACE_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
UPPER = r"\p{Lu}\x{2160}-\x{216F}"

# fixed values: what is recognised in a post
URL = rf"https?://[^{SPACE}]+"
MENTION = r"@[A-Za-z0-9_]+"
HASHTAG = r"#[\p{L}\p{N}_]+"
RESERVED = rf"RT(?![{WORD}])(?<![{WORD}]RT)|FAV(?![{WORD}])(?<![{WORD}]FAV)"
EMOJI = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
SMILEY = r"[:;=][-o^']?[)(DPp/\\|]"
NUMBER = r"\d+"
PICTURE = rf"pic.twitter.com[^{SPACE}]+"
EXCLAMATION = r"(\!)"
QUESTION = r"(\?)"
DOLLAR = r"(\$)"
PUNCTUATION = rf"[^{WORD}{SPACE}]"

# fixed values: looser variants used while exploring raw content
LOOSE_HASHTAG = rf"(#[{WORD}]*)"
LOOSE_HASHTAG_NAME = rf"#([{WORD}]*)"
LOOSE_LINK = rf"(https[^{SPACE}]+)"
LOOSE_MENTION = rf"(@[{WORD}]*)"

# fixed values: order in which a post is cleaned
CLEANING_ORDER = [URL, PICTURE, MENTION, HASHTAG, RESERVED, EMOJI, SMILEY, NUMBER]

# fixed values: a match contains one of these, so a text without them needs no regex
NEEDLES = {
    URL: ["http"],
    PICTURE: ["twitter"],
    MENTION: ["@"],
    HASHTAG: ["#"],
    RESERVED: ["RT", "FAV"],
    SMILEY: [":", ";", "="],
}

# fixed values: characters that most of a text is made of
COMMON = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"


def after(common: str, characters: str) -> str:
    """A class without `common` characters, which are ruled out first: a table tells them, and the class is not tried."""
    return rf"[[^{common}]&&{characters}]"


# fixed values: faster forms with the same matches, for Java's regular expressions
QUICK = {
    EMOJI: after(r"\x{0}-\x{25FF}", EMOJI),
    PUNCTUATION: after(rf"{COMMON} \n", PUNCTUATION),
    rf"[{UPPER}]": after(rf"{COMMON.translate({c: None for c in range(65, 91)})} \n", rf"[{UPPER}]"),
    rf"[{SPACE}]+": after(COMMON, rf"[{SPACE}]") + "+",
}

# fixed values: words the tokeniser splits in two, as (head, tail)
CONTRACTIONS = [
    ("can", "not"),
    ("gim", "me"),
    ("gon", "na"),
    ("got", "ta"),
    ("lem", "me"),
    ("wan", "na"),
]

# fixed values: stop words dropped by the word vectoriser
VECTORISER_STOP_WORDS = ["american", "obamas", "supporter", "thanks"]

# fixed values: emoticons counted as happy or sad
HAPPY_EMOTICONS = [
    ":-)", ":)", ";)", ":o)", ":]", ":3", ":c)", ":>", "=]", "8)", "=)", ":}",
    ":^)", ":-D", ":D", "8-D", "8D", "x-D", "xD", "X-D", "XD", "=-D", "=D",
    "=-3", "=3", ":-))", ":'-)", ":')", ":*", ":^*", ">:P", ":-P", ":P", "X-P",
    "x-p", "xp", "XP", ":-p", ":p", "=p", ":-b", ":b", ">:)", ">;)", ">:-)",
    "<3",
]
SAD_EMOTICONS = [
    ":L", ":-/", ">:/", ":S", ">:[", ":@", ":-(", ":[", ":-||", "=L", ":<",
    ":-[", ":-<", "=\\", "=/", ">:(", ":(", ">.<", ":'-(", ":'(", ":\\", ":-c",
    ":c", ":{", ">:\\", ";(",
]

# fixed values: English function words removed after tokenising
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours
yourself yourselves he him his himself she she's her hers herself it it's its
itself they them their theirs themselves what which who whom this that that'll
these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down
in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so
than too very s t can will just don don't should should've now d ll m o re ve y
ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't
shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn
wouldn't
""".split()
