"""Word lists that fix the results of name preparation and filters."""

# Spelling variants of names, replaced in this order.
SPELLING_PAIRS = [
    ("abenon", "abinum"), ("abinon", "abinum"), ("abinun", "abinum"), ("aharon", "aron"), ("ahron", "aron"), ("alberto", "albert"),
    ("alcalay", "alkalaj"), ("aleksander", "aleksandar"), ("alessandro", "aleksandar"), ("alexandar", "aleksandar"), ("alexander", "aleksandar"),
    ("alhalel", "alkalaj"), ("alkajal", "alkalaj"), ("alkalay", "alkalaj"), ("alkelai", "alkalaj"), ("alnahari", "albahari"), ("altarak", "altarac"),
    ("altaras", "altarac"), ("altaratz", "altarac"), ("altaraz", "altarac"), ("altarec", "altarac"), ("alterac", "altarac"), ("andjela", "andela"),
    ("angela", "andela"), ("aronne", "aron"), ("ashkenazi", "eskenazi"), ("askenazi", "eskenazi"), ("attias", "atias"), ("avigail", "abigal"),
    ("avram", "abram"), ("avramovicj", "abramovic"), ("awinon", "abinon"), ("bencijon", "bencion"), ("beniamin", "benjamin"), ("bension", "bencion"),
    ("bentzion", "bencion"), ("benzion", "bencion"), ("bernhard", "bernard"), ("bernhart", "bernard"), ("blanca", "blanka"),
    ("bogdanovitz", "bogdanovic"), ("cabiglio", "kabiljo"), ("cabilio", "kabiljo"), ("cohen", "koen"), ("conforti", "konforti"),
    ("elazar", "eleazar"), ("elia", "ilija"), ("eliash", "ilija"), ("elias", "ilija"), ("elieser", "eleazar"), ("eliezer", "eleazar"),
    ("elijas", "ilija"), ("elijau", "ilija"), ("elisha", "ilija"), ("elkelai", "alkalaj"), ("engel", "angel"), ("eshenazi", "eskenazi"),
    ("eskanazi", "eskenazi"), ("esparansa", "esperanca"), ("esperansa", "esperanca"), ("estera", "ester"), ("esther", "ester"), ("eugel", "eugen"),
    ("fincy", "finci"), ("finki", "finci"), ("fintzi", "finci"), ("gott", "got"), ("grunwald", "grinvald"), ("hajnrich", "heinrich"),
    ("hajnrich", "henrik"), ("hajnrih", "heinrich"), ("hajnrih", "henrik"), ("hayim", "haim"), ("heim", "haim"), ("heinrich", "henrik"),
    ("heinrih", "heinrich"), ("henrich", "henrik"), ("hertzer", "hercer"), ("icchak", "isak"), ("israejl", "israel"), ("izak", "isak"),
    ("izrael", "israel"), ("jaakow", "jakov"), ("jacob", "jakov"), ("jacov", "jakov"), ("jakob", "jakov"), ("jakow", "jakov"), ("janihel", "jahiel"),
    ("jcchak", "isak"), ("jichak", "isak"), ("johann", "johan"), ("josif", "josef"), ("josip", "josef"), ("jozef", "josef"), ("julius", "julio"),
    ("jzaak", "isak"), ("kabiglio", "kabiljo"), ("kabilio", "kabiljo"), ("kabilo", "kabiljo"), ("khana", "hana"), ("kohen", "koen"),
    ("komforte", "konforti"), ("komforti", "konforti"), ("konforte", "konforti"), ("kunorti", "konforti"), ("liliana", "ljiljana"), ("lilli", "lili"),
    ("lilly", "lili"), ("lily", "lili"), ("macstro", "maestro"), ("mekhael", "mihael"), ("menaham", "menahem"), ("mihajlo", "mihael"),
    ("moise", "mose"), ("moisie", "mose"), ("moiso", "mose"), ("mojsije", "mose"), ("mordechai", "mordehaj"), ("mosche", "mose"), ("moshe", "mose"),
    ("moso", "mose"), ("mosze", "mose"), ("nadezhda", "nadezda"), ("pinhas", "pinkas"), ("pollak", "polak"), ("rafajl", "rafael"),
    ("rakhel", "rahel"), ("refael", "rafael"), ("rifca", "rifka"), ("rifha", "rifka"), ("rifika", "rifka"), ("rivka", "rifka"), ("riwka", "rifka"),
    ("sabedaj", "sabetaj"), ("salomon", "salamon"), ("samoel", "samuel"), ("schwarc", "svarc"), ("schwarz", "svarc"), ("shabtai", "sabetaj"),
    ("shimshon", "simson"), ("shmuel", "samuel"), ("shtern", "stern"), ("smuel", "samuel"), ("sofie", "sofija"), ("solomon", "salamon"),
    ("szalom", "salamon"), ("tzadok", "zadok"), ("yaakov", "jakov"), ("yacob", "jakov"), ("yakow", "jakov"), ("yehoshua", "jesua"),
    ("yekhiel", "jahiel"), ("yisrael", "israel"), ("yitzkhak", "isak"), ("yosef", "josef"), ("ytzkhak", "isak"),
]

# Letter simplifications, replaced in this order.
LETTER_PAIRS = [
    ("hh", "h"), ("ll", "l"), ("ph", "f"), ("dj", "d"), ("ch", "h"), ("th", "t"), ("y", "j"), ("kh", "h"), ("sh", "s"), ("ae", "a"), ("oe", "o"),
    ("ue", "u"), ("tz", "c"), ("z", "s"), ("ss", "s"), ("ije", "je"), ("je", "e"), ("ij", "i"), ("j", "i"), ("w", "v"),
]

# Death places that are left out, and the categories they are counted in (first that fits).
LEFT_OUT_PLACES = [
    "u logoru", "Jasenovac", "Jaenovac", "Nepoznato", "Stara Gradiška", "St. Gradiška", "St Gradiška", "Stara grediška", "Stara gardiška",
    "Stara gadiška", "St.gradiška", "Nepoznati logor", "Log. nepoznat", "Log.nepo.", "Konc.logor", "Jasenovac-logor", "Mlaka", "Jablanac",
    "Krapje", "Bročice", "Gradina",
]
PLACE_CATEGORIES = [
    "Jasenovac", "Jaenovac", "Stara Gradiška", "St. Gradiška", "St Gradiška", "Stara grediška", "Stara gardiška", "Stara gadiška",
    "St.gradiška", "Jasenovac-logor", "Mlaka", "Jablanac", "Krapje", "Bročice", "Gradina",
]

