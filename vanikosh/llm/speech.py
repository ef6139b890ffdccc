"""A line parser for transcript segments, shared by the turn and language operators.

A segment's text, in the form of problem 1, is read once from left to right as a
sequence of time stamps, speaker names, annotations and words: the states of a
small finite-state machine whose transitions are the alternatives of one
pattern. The known layouts are caption cues (``00:01:02.500 -->``), voice tags
(``<v Speaker 1>``), bracketed or bare clock times, ``@12.5s``, ``{t=12.5}``,
``[1m05s]``, and names by number, letter, role or id, bracketed or followed by
a colon, dash or angle bracket.
"""

from __future__ import annotations

import re

from vanikosh.llm.canon import VISARGAS, canonical

# --- fixed values: words of the layouts ---------------------------------------

#: What a numbered or lettered speaker is called.
SPEAKER_WORDS = ("speaker", "spkr", "spk", "वक्ता", "स्पीकर", "বক্তা", "স্পিকার")

#: Names of the roles, by role.
ROLE_WORDS = {
    "host": ("host", "मेज़बान", "मेजबान", "होस्ट", "यजमान", "सूत्रधार", "হোস্ট", "সঞ্চালক", "উপস্থাপক", "mezbaan", "mezban"),
    "guest": ("guest", "मेहमान", "अतिथि", "गेस्ट", "पाहुणा", "पाहुणे", "অতিথি", "মেহমান", "গেস্ট", "mehmaan", "mehman"),
    "caller": ("caller", "कॉलर", "फ़ोनकर्ता", "কলার"),
    "guide": ("guide", "गाइड", "मार्गदर्शक", "গাইড", "পথপ্রদর্শক"),
}

#: Contents of round brackets that are annotations; other bracket kinds hold annotations only.
NOTE_WORDS = (
    "music", "laughs", "laughter", "laughing", "laugh", "applause", "cough", "coughs", "coughing", "noise", "background noise", "silence",
    "inaudible", "unintelligible", "unclear", "crosstalk", "phone rings", "phone ringing", "door slams", "door closes", "pause", "sighs",
    "sneeze", "sneezes", "breath", "breathing", "clapping", "wind", "wind noise", "static", "beep", "clears throat", "overlapping speech",
    "संगीत", "हँसी", "हंसी", "तालियाँ", "तालियां", "खाँसी", "खांसी", "शोर", "मौन", "चुप्पी", "अस्पष्ट", "हवा का शोर", "फ़ोन की घंटी",
    "फोन की घंटी", "दरवाज़े की आवाज़", "दरवाजे की आवाज", "पृष्ठभूमि शोर", "विराम", "छींक", "हशा", "टाळ्या", "खोकला", "आवाज", "शांतता",
    "সঙ্গীত", "সংগীত", "হাসি", "হাততালি", "কাশি", "শব্দ", "নীরবতা", "অস্পষ্ট", "ফোনের শব্দ", "দরজার শব্দ", "বাতাসের শব্দ",
)

# --- pattern --------------------------------------------------------------------

_CLOCK = r"\d{1,3}(?::\d{2}){1,2}(?:[.,]\d{1,3})?"
_OPEN, _CLOSE = r"[\[(<{]\s*", r"\s*[\])>}]"
_ROLE_OF = {canonical(w, "lower"): role for role, words in ROLE_WORDS.items() for w in words}
_NOTES = {canonical(w, "lower") for w in NOTE_WORDS}
_OPENED = {" ".join(n.split()[:k]) for n in _NOTES for k in range(1, len(n.split()) + 1)}
_ALT = lambda words: "|".join(sorted({canonical(w) for w in words}, key=len, reverse=True))
_NAMED = rf"(?i:(?:{_ALT(SPEAKER_WORDS)})[ _.#-]{{0,2}}\d{{1,3}}|(?:{_ALT(SPEAKER_WORDS)})(?:[ _-]?[a-rt-z]|[ _-]s)|s\d{{1,3}}|id[ _:#-]{{0,2}}\d+|{_ALT(_ROLE_OF)})"
_STAMP = "|".join(
    (
        rf"{_OPEN}(?:t\s*=\s*)?{_CLOCK}(?:\s*-->\s*{_CLOCK})?{_CLOSE}",
        rf"{_OPEN}(?:\d+\s*h\s*)?\d+\s*m(?:in)?\s*\d+(?:\.\d+)?\s*s{_CLOSE}",
        rf"{_OPEN}t\s*=\s*\d+(?:\.\d+)?s?{_CLOSE}",
        rf"{_OPEN}\d+(?:\.\d+)?\s*s(?:ec)?{_CLOSE}",
        r"(?<!\S)@\d+(?:\.\d+)?s?(?!\S)",
        rf"(?<!\S){_CLOCK}\s*(?:-->(?:\s*{_CLOCK})?|[-–—])(?!\S)",
    )
)
_NAME = "|".join(
    (
        rf"<v\s+({_NAMED}|[A-Z])\s*>",
        rf"[\[({{]\s*({_NAMED}|[A-Z])\s*:?\s*[\])}}]:?",
        rf"(?<!\S)({_NAMED})(?:\s?(?::|>|[-–—](?!\S))(?!\S)|:(?![\d/])|[{VISARGAS}](?=\w))",  # a colon before a letter of the same script has become a visarga
        r"(?<!\S)([A-H]) ?[:>](?!\S)",
    )
)
_NOTE = (
    r"\(\([^()]*\)\)|\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>|\*[^*]*\*|♪[^♪]*♪"
    rf"|(?:[\[{{<]|\((?![^()]*\)))(?i:{_ALT(_OPENED)})(?:\s\d+s)?(?![^\s.,;!?।])"  # left open
)
_ITEM = re.compile(rf"(?P<stamp>{_STAMP})|(?P<name>{_NAME})|(?P<note>{_NOTE})|(?P<round>\([^()\[\]{{}}<>*♪]*\))")
_MARKED = re.compile(rf"[\[{{(<*♪@>:]|[-–—](?:\s|$)|(?:{_ALT([*SPEAKER_WORDS, *_ROLE_OF])})[{VISARGAS}]")
_NOTE_TAIL = re.compile(r"(?:\s*\d+(?:\.\d+)?\s*s)?\s*/?$")
_EDGE = "।॥|!\"#$%&'()*+,-./:;<=>?@[\\]^_`{}~…–—‘’“”«»•·♪→¿¡"
_RUN = re.compile(r"(.)\1+")
_HALVES = re.compile("(\\w\u094d)\\1+")


def is_note(content: str) -> bool:
    """Whether the content of a bracket is a known annotation, maybe with a duration or a closing slash."""
    return _NOTE_TAIL.sub("", content.strip().lower()) in _NOTES


def filler_forms(terms) -> frozenset[str]:
    """Hesitations by their form without drawn-out letters."""
    return frozenset(squeeze(canonical(t, "lower")) for t in terms if t and t.strip())


def squeeze(word: str) -> str:
    """A word with every drawn-out letter, or half letter of an Indic script, written once."""
    return _HALVES.sub(r"\1", _RUN.sub(r"\1", word))


class LineParser:
    """Parses texts into pieces; remembers words and whole texts that come again, within a bound."""

    def __init__(self, fillers=(), memory: int = 200_000):
        self.fillers, self.memory = filler_forms(fillers), memory
        self._cores: dict[str, str] = {}

    def core(self, token: str) -> str:
        """The token without punctuation at its ends; empty if it is no word or a hesitation."""
        got = self._cores.get(token)
        if got is None:
            if len(self._cores) >= self.memory:
                self._cores.clear()
            got = token.strip(_EDGE)
            if not any(c.isalnum() for c in got) or squeeze(got.lower()) in self.fillers:
                got = ""
            self._cores[token] = got
        return got

    def pieces(self, form: str) -> list[tuple[str | None, list[str]]]:
        """The pieces of a text in canonical form: who is named (None: nobody), and the kept tokens, maybe none.

        Names are ``n1`` (number), ``rhost`` (role) or ``i600004`` (id).
        """
        core = self.core
        if not _MARKED.search(form):
            return [(None, [t for t in form.split(" ") if core(t)])] if form else []
        who, at, out = None, 0, []
        tokens: list[str] = []
        for m in _ITEM.finditer(form):
            kind = m.lastgroup or "name"
            if kind == "round":
                if m[0][1:-1].strip() and not is_note(m[0][1:-1]):
                    continue
            tokens += form[at : m.start()].split(" ")
            at = m.end()
            if m["name"] is not None:
                out.append((who, [t for t in tokens if core(t)]))
                who, tokens = _reference(next(g for g in m.groups()[2:6] if g)), []
        tokens += form[at:].split(" ")
        out.append((who, [t for t in tokens if core(t)]))
        return out


def _reference(name: str) -> str:
    name = name.lower()
    digits = re.search(r"\d+", name)
    if digits:
        return ("i" if name.startswith("id") else "n") + str(int(digits[0]))
    if name in _ROLE_OF:
        return "r" + _ROLE_OF[name]
    return "n" + str(ord(name[-1]) - ord("a") + 1)
