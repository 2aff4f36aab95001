"""Word lists, rules and grids that results depend on."""

# fixed values
NAME_WORDS = {"corp": "corporation", "intl": "international", "svc": "services", "svcs": "services"}
LEGAL_ENDINGS = ("private limited", "pvt ltd", "pvt limited", "private ltd", "limited", "ltd", "incorporated", "inc", "llc", "llp", "plc")
ADDRESS_WORDS = {"road": "rd", "street": "st", "avenue": "ave", "boulevard": "blvd", "drive": "dr", "lane": "ln", "suite": "ste", "apartment": "apt"}
GENERIC_NAME = ("and", "the", "of", "company", "corporation", "group", "services", "international")
GENERIC_ADDRESS = ("rd", "st", "ave", "ln", "blvd", "dr", "near", "main", "building", "apt", "ste", "and", "the")
GENERIC_KEY_NAME = (*GENERIC_NAME, "inc", "ltd", "limited", "private", "pvt", "llc", "llp", "corp", "co")
GENERIC_KEY_ADDRESS = (*GENERIC_ADDRESS, "floor", "block", "flat", "opposite", "unit", "pmb", "road", "street", "lane", "avenue", "drive")
GENERIC_EVIDENCE = (*GENERIC_KEY_NAME, "sarl", "sas", "sasu", "sci", "eurl", "sa", "association")
GENERIC_VETO = (*GENERIC_EVIDENCE, "pllc")
GENERIC_SOUNDEX = ("P613", "L533", "S612", "C515")
STOPWORDS = ("and", "the", "of", "for", "in", "on", "at", "to", "a", "&", "de", "du", "la", "le")
LEGAL_FORMS = {
    1: ("llc", "pllc"),
    2: ("inc", "corp", "corporation"),
    3: ("ltd", "limited", "pvt"),
    4: ("llp",),
    5: ("co", "company"),
    6: ("sa", "sarl", "sas", "sasu", "sci", "eurl"),
    7: ("foundation", "trust", "association"),
}
CATEGORIES = {
    "medical": ("clinic", "hospital", "dental", "dds", "md", "pharma", "pharmacy", "health", "healthcare", "medical", "surgery", "care", "medicine"),
    "education": ("school", "college", "academy", "institute", "university", "education", "classes", "vidyalaya", "gurukula"),
    "food": ("cafe", "restaurant", "bakery", "pizza", "grill", "bar", "kitchen", "hotel", "dining", "foods", "sweets", "dhaba"),
    "finance": ("bank", "capital", "finance", "financial", "wealth", "investment", "securities", "insurance", "finserv"),
    "real_estate": ("realty", "realestate", "construction", "builders", "developers", "properties", "infra", "infrastructure"),
    "logistics": ("logistics", "transport", "cargo", "movers", "freight", "travels", "tourist", "motors", "auto"),
    "tech": ("technologies", "software", "it", "solutions", "tech", "systems", "digital", "infotech"),
    "retail": ("mart", "store", "shop", "enterprise", "retail", "supermart", "trading", "jewellers", "boutique", "jewellery"),
}
# blocking rules, in the order of their bits
RULES = ("country_name", "city_name", "postal", "name_ngram", "address", "strong_name", "name_number", "address_number", "name_pair")
# postal patterns at the end of an address, in order of precedence
POSTAL = (r"\b([a-z]\d[a-z]\s?\d[a-z]\d)\s*$", r"\b([a-z]{1,2}\d[a-z\d]?\s*\d[a-z]{2})\s*$", r"\b(\d{4,10}(?:-\d{3,4})?)\s*$")
STREET_NUMBER = r"^\s*(\d+[a-z]?(?:[-/]\d+[a-z]?)?)\b"
# offsets modulo 0x80 in the Indic blocks, and the Latin letter that stands for them
INDIC_LETTERS = {
    "k": (0x15, 0x16, 0x17, 0x18),
    "n": (0x19, 0x1E, 0x23, 0x28),
    "c": (0x1A, 0x1B, 0x1C, 0x1D),
    "t": (0x1F, 0x20, 0x21, 0x22, 0x24, 0x25, 0x26, 0x27),
    "p": (0x2A, 0x2B, 0x2C, 0x2D),
    "m": (0x2E,),
    "y": (0x2F,),
    "r": (0x30,),
    "l": (0x32,),
    "v": (0x35,),
    "s": (0x36, 0x37, 0x38),
    "h": (0x39,),
    "a": (0x05, 0x06, 0x3E),
    "i": (0x07, 0x08, 0x3F, 0x40),
    "u": (0x09, 0x0A, 0x41, 0x42),
    "e": (0x0F, 0x10, 0x47, 0x48),
    "o": (0x13, 0x14, 0x4B, 0x4C),
}
LATIN_FOLDS = {"a": "ÀÁÂÃÄÅàáâãäå", "e": "ÈÉÊËèéêë", "i": "ÌÍÎÏìíîï", "o": "ÒÓÔÕÖòóôõö", "u": "ÙÚÛÜùúûü", "c": "Çç"}
# consonants that count as one, in order
DIGRAPHS = {"ph": "f", "bh": "b", "dh": "d", "th": "t", "kh": "k", "sh": "s", "w": "v"}
# contacts: an address with its local part and domain, a link, a labelled telephone number
EMAIL = r"(?<![\w.+-])([\w.!#$%&'*+/=?^`{|}~-]+)@([\w-]+(?:\.[\w-]+)+)"
LINK = r"(?:https?://|www\.)[^\s<>|]+"
TELEPHONE = r"\b(?:tel(?:ephone)?|phone|mobile|mob)\s*[:=]\s*(\+?[\d() .-]{7,25})"
