"""Fixed values that results depend on: word lists, tables of signs, ranges, limits."""

# Openings that show a reader talking about the page instead of copying it.
CHATTER = (
    "i can see",
    "i cannot",
    "this page appears",
    "this page is",
    "this image appears",
    "this image shows",
    "the image appears",
    "however,",
    "if you have",
    "please provide",
    "there is no visible printed text",
    "there is no substantive",
    "there is no discernible",
    "no substantial printed text",
    "no readable printed text",
    "no clearly legible",
    "would be happy to",
    "cannot identify any readable",
    "does not appear to contain",
    "not appear to contain printed",
)
PATCH_CHATTER = ("i can see", "i cannot", "however,", "the sentence", "here is", "corrected sentence")
BOILERPLATE = (
    "google books",
    "books.google",
    "books.google.com",
    "about this book",
    "acerca de este libro",
    "terms of use",
    "normas de uso",
    "public domain",
    "dominio público",
    "non-commercial",
    "no comercial",
    "automated querying",
    "consultas automatizadas",
    "búsqueda de libros de google",
    "book search",
)
EDITORIAL_HEADERS = ("PRESENTACIÓN", "PRESENTACION", "INTRODUCCIÓN", "INTRODUCCION", "PRÓLOGO", "PROLOGO", "NOTA DEL EDITOR", "AGRADECIMIENTOS", "ESTUDIO PRELIMINAR", "NOTA PRELIMINAR")
EDITORIAL_PROSE = ("presentación", "biblioteca", "universidad", "edición", "colección", "paleografía", "paleografia", "transcripción", "transcripcion", "manuscrito", "introducción", "introduccion", "capítulo", "capitulo", "agradecimiento", "sin embargo", "por lo tanto", "asimismo", "cabe señalar", "cabe senalar", "en este trabajo", "el presente volumen")
TRANSLATION_PROSE = ("traducción", "traduccion", "dice el texto", "en español", "en espanol", "moquíhuix", "moquihuix", "los mexicas", "dieron principio", "año de", "año del")
NAHUATL_SIGNS = ("nican", "moteneu", "çoatl", "coatl", "tepetl", "tlahtoani", "tlahtoa", "xiuhmolpilli", "quauhtla", "xochitl", "ēhecatl", "ehecatl", "miquiztli", "tochtli", "acatl")
COLONIAL_SPANISH = ("como", "que", "los", "las", "del", "por", "con", "habia", "habían", "abian", "venido", "alli", "allí", "entonces", "despues", "después", "dijo", "tenia", "tenía", "señor", "senor", "año", "porque", "porq", "esto", "esta", "aquel", "aquella", "donde", "cuando", "muchos", "muchas", "tambien", "también", "ciudad", "açordaron", "çerto", "çaminos")
BRACKET_ASIDE = ("sic", "illegible", "damaged", "?", "…", "...")
SPANISH_HINTS = ("el", "la", "los", "las", "de", "del", "que", "y", "en", "un", "una", "por", "con", "su", "sus", "se", "al", "lo", "como", "pero", "mas", "más", "para", "es", "son", "fue", "ser", "esta", "este", "estos", "estas", "don", "doña", "donde", "cuando")
INDIGENOUS = "(?iu)[āēīōū]|tl|tz|qu|tzin|catl|tlan"

# Superscripts: digits, o and a as ordinals, the letters that have a modifier form (q has none).
SUPER_FROM = "0123456789oabcdefghijklmnprstuvwxyz"
SUPER_TO = "⁰¹²³⁴⁵⁶⁷⁸⁹ºªᵇᶜᵈᵉᶠᵍʰⁱʲᵏˡᵐⁿᵖʳˢᵗᵘᵛʷˣʸᶻ"
NOTE_DIGITS = "¹²³⁴⁵⁶⁷⁸⁹⁰"

# Script -> first and last code point.
SCRIPT_RANGES = {"latin": (0x0041, 0x024F), "arabic": (0x0600, 0x06FF), "korean": (0xAC00, 0xD7A3), "japanese": (0x3040, 0x30FF), "chinese": (0x4E00, 0x9FFF)}
LEAST_CONTENT_CHARS = 50
LATIN_SHARE, OTHER_SCRIPT_SHARE = 0.80, 0.15

CONFIDENCE_THRESHOLD = 85.0
PATCHES_PER_PAGE = 8
OUTPUT_TOKENS, TOKEN_MARGIN, CHARS_PER_TOKEN = 8192, 512, 3
FOOTNOTE_BAND = 0.78
LEAST_REGION_CHARS = 8
RATE_WINDOW_S, RATE_LIMIT = 60, 60
PROMOTE_ATTEMPTS, DEMOTE_CHECKS = 10, 5
DIFFERENCE_CHARS = 800
HARD_TERM_CHARS = 12

LANGUAGE_ALIASES = {
    "spanish": "spanish",
    "colonial spanish": "spanish",
    "castilian": "spanish",
    "nahuatl": "nahuatl",
    "classical nahuatl": "nahuatl",
    "mexica nahuatl": "nahuatl",
    "kaqchikel": "kaqchikel",
    "kaqchikel maya": "kaqchikel",
    "yucatec": "yucatec_maya",
    "yucatec maya": "yucatec_maya",
    "maya": "classical_maya",
    "classical maya": "classical_maya",
    "korean": "korean",
    "japanese": "japanese",
    "arabic": "arabic",
    "chinese": "chinese",
}
#: Languages with rules of their own.
RULED_LANGUAGES = ("spanish", "nahuatl", "yucatec_maya", "classical_maya", "kaqchikel", "korean", "japanese", "arabic")
FOOTNOTE_START, FOOTNOTE_END, FOOTNOTES, IMAGE = "--- FOOTNOTE ---", "--- END FOOTNOTE ---", "--- FOOTNOTES ---", "[IMAGE]"

# Fragments in brackets at the ends and starts of pages.
OPEN_END = r"\[([^\]\n]+)-\s*$"
UNCLOSED_END = r"\[[^\]\n]*$"
CLOSE_START = r"(?s)^([^\[\n\]]+)\](.*)$"
ORPHAN_START = r"^[^\[]*\]"

# Texts of reports and sentinels.
REVIEW_HEADER = "# Flagged spans requiring human review"
PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"
MISSING_PASS4 = "[Pass 4 failed: missing batch result]"
EXTRA_FLAGS = {"footnote_region": "[FOOTNOTE REGION]", "complex_layout_language_switch": "[LANGUAGE SWITCH]"}

# Jobs, and signs that end sentences in Japanese and Chinese.
DEFAULT_MODE = "auto"
PILOT_PAGES = 10
CJK_TERMINATORS = "。、！？"
