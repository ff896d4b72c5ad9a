"""Word lists that queries need, as SQL lists."""

# Words that carry no content in a question.
STOPWORDS = """a au aux avec ce ces cet cette comment dans de des donne donner donnee donnees du elle elles en entre est et etre
il ils indique indiquer information informations la le les leur leurs ma mes moins mon ne nos notre numero ou par pas plus pour pourquoi
precise preciser quand que quel quelle quelles quels qui quoi reference references sa sans selon ses son sont sous sur ta tes ton tous tout
toute toutes tres un une valeur valeurs vos votre combien about and are does for from how many much number of the these this those value
values what which with""".split()

# Words that mark a language; forms that both have are left out.
FRENCH = """au aux avec ce ces cette dans de des du elle est et il la le les leur leurs ne nous par pas pour quel quelle quelles quels qui sont sur
une vous""".split()
ENGLISH = """and are be by does for from has have how in into is it its not of that the their there these this those to was were what when where
which who why with""".split()

# Groups of words with one meaning in two languages.
ALIASES = (
    ("voltage", "tension"),
    ("current", "courant"),
    ("supply", "alimentation"),
    ("input", "entree", "entrees"),
    ("output", "sortie", "sorties"),
    ("temperature", "temperatures"),
    ("range", "plage", "intervalle", "interval", "bornes"),
    ("min", "minimum", "minimale", "minimal"),
    ("max", "maximum", "maximale", "maximal"),
    ("condition", "conditions", "essai", "essais", "test"),
)

# Words of the roles that a limit can have.
ROLES = {
    "operating": ("operating", "operation", "fonctionnement", "admissible", "admissibles", "recommended"),
    "absolute": ("absolute", "absolue", "absolues", "absolu", "absolus"),
    "typical": ("typical", "typique", "typiques"),
    "test": ("test", "essai", "essais", "characterization", "caracterisation"),
}

# Unit, dimension, factor and offset to the base unit of the dimension.
UNITS = (
    ("V", "voltage", "1", "0"), ("mV", "voltage", "0.001", "0"), ("kV", "voltage", "1000", "0"),
    ("A", "current", "1", "0"), ("mA", "current", "0.001", "0"), ("µA", "current", "0.000001", "0"),
    ("W", "power", "1", "0"), ("mW", "power", "0.001", "0"), ("kW", "power", "1000", "0"),
    ("Hz", "frequency", "1", "0"), ("kHz", "frequency", "1000", "0"), ("MHz", "frequency", "1000000", "0"),
    ("Ω", "resistance", "1", "0"), ("kΩ", "resistance", "1000", "0"), ("MΩ", "resistance", "1000000", "0"),
    ("s", "time", "1", "0"), ("ms", "time", "0.001", "0"), ("min", "time", "60", "0"), ("h", "time", "3600", "0"),
    ("m", "length", "1", "0"), ("mm", "length", "0.001", "0"), ("cm", "length", "0.01", "0"), ("km", "length", "1000", "0"),
    ("Pa", "pressure", "1", "0"), ("kPa", "pressure", "1000", "0"), ("MPa", "pressure", "1000000", "0"), ("bar", "pressure", "100000", "0"),
    ("µs", "time", "0.000001", "0"), ("ns", "time", "0.000000001", "0"), ("F", "capacitance", "1", "0"), ("µF", "capacitance", "0.000001", "0"),
    ("nF", "capacitance", "0.000000001", "0"), ("pF", "capacitance", "0.000000000001", "0"), ("K", "temperature", "1", "0"), ("°C", "temperature", "1", "273.15"),
)

# Other spellings of units.
UNIT_ALIASES = {
    "uA": "µA", "μA": "µA", "us": "µs", "μs": "µs", "uF": "µF", "μF": "µF", "ohm": "Ω", "ohms": "Ω", "° C": "°C", "°\u00a0C": "°C",
}


def sql_list(words) -> str:
    """Words as the inside of an IN list."""
    return ", ".join(f"'{w}'" for w in words)


def alias_rows() -> str:
    """Rows (group, word) of the alias groups for VALUES."""
    return ", ".join(f"({i}, '{w}')" for i, group in enumerate(ALIASES) for w in group)


def role_rows() -> str:
    """Rows (role, word) for VALUES."""
    return ", ".join(f"('{role}', '{w}')" for role, words in ROLES.items() for w in words)


def unit_rows() -> str:
    """Rows (unit, dimension, factor, offset) for VALUES; numbers as doubles."""
    return ", ".join(f"('{u}', '{d}', cast({f} as double), cast({o} as double))" for u, d, f, o in UNITS)
