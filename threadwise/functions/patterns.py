"""Character classes of the text expressions, in Java regex syntax.

Counts follow Unicode (word characters, white space, upper case, digits). Each class names its ASCII
members first and reaches the wide Unicode part only for characters beyond ASCII, because a Java union
of many ranges is tested range by range: on Latin text this is several times faster.
"""


def _class(ascii_part: str, beyond: str) -> str:
    return rf"{ascii_part}[\x{{80}}-\x{{10FFFF}}&&[{beyond}]]"


# Members beyond ASCII of white space, upper case and digits.
SPACE_BEYOND_ASCII = (
    r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
UPPER_BEYOND_ASCII = (
    r"\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}"
)
DIGIT_BEYOND_ASCII = (
    r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}"
    r"\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}"
    r"\x{1F100}-\x{1F10A}"
)
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_WORD_CLASS = _class("A-Za-z0-9_", r"\p{L}\p{N}")

SPACES = f"[{_class(r'\x{9}-\x{D}\x{1C}-\x{20}', SPACE_BEYOND_ASCII)}]+"
NOT_UPPER = f"[^{_class('A-Z', UPPER_BEYOND_ASCII)}]+"
NOT_DIGIT = f"[^{_class('0-9', DIGIT_BEYOND_ASCII)}]+"
NOT_WORD = f"[^{_WORD_CLASS}]+"
LONG_WORD = f"[{_WORD_CLASS}]{{3,}}"
TERM = f"[{_WORD_CLASS}]{{2,}}"

# An address-like run: one character, '@', then text up to the next '@' with a dot inside it. Only the
# ends of the runs are named, so that a long text without '@' takes linear time.
EMAIL = r"[^@]@[^@]+\.[^@]"

API_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
