"""The taxonomy, glossaries, keyword buckets and patterns that results depend on."""

# Categories in canonical order, each with label, severity range and sub-dimensions.
CATEGORIES = [
    ("VDG_VIOLENCIA_SIMBOLICA", "Violencia Simbólica", "baja-media", [
        ("1.1", "Roles tradicionales y de sumisión"),
        ("1.2", "Incompetencia e inferioridad intelectual o física"),
        ("1.3", "Castigo moral y patologización")]),
    ("VDG_COSIFICACION_SLUTSHAMING", "Mercantilización Corporal", "media", [
        ("2.1", "Cosificación e hipersexualización"),
        ("2.2", "Escrutinio corporal y body-shaming"),
        ("2.3", "Doble estándar sexual y slut-shaming")]),
    ("VDG_HOSTILIDAD_FEMINICIDIO", "Hostilidad / Feminicidio", "alta-extrema", [
        ("3.1", "Castigos disciplinantes no sexuales"),
        ("3.2", "Deseos de violencia letal"),
        ("3.3", "Apología al feminicidio")]),
    ("VDG_MANOSFERA_ANTIFEMINISMO", "Manosfera / Antifeminismo", "media-alta", [
        ("4.1", "Subculturas masculinistas y jerarquías de dominación"),
        ("4.2", "Oposición antifeminista y victimismo hegemónico"),
        ("4.3", "Trolleo, castigo y emasculación"),
        ("4.4", "Arquetipos femeninos deshumanizantes")]),
    ("VDG_DESACREDITACION_ACTIVISTAS", "Castigo Del Empoderamiento Femenino", "media-alta", [
        ("5.1", "Deslegitimación del empoderamiento"),
        ("5.2", "Ridiculización tradicional del empoderamiento"),
        ("5.3", "Falacia de superioridad moral")]),
    ("VDG_SALVAGUARDA_FALSO_POSITIVO", "Salvaguarda (Falso Positivo)", "ortogonal", [
        ("6.1", "Micromachismos y mansplaining"),
        ("6.2", "Humor hostil"),
        ("6.3", "Salvaguarda y falsos positivos")]),
]
NONE = "ninguna"
SAFEGUARD = "VDG_SALVAGUARDA_FALSO_POSITIVO"
JUNK, COMMON = "CODIGO_99", "VIOLENCIA_COMUN"
# The order in which free-form categories are matched.
MATCH_ORDER = ["VDG_VIOLENCIA_SIMBOLICA", "VDG_COSIFICACION_SLUTSHAMING", "VDG_HOSTILIDAD_FEMINICIDIO",
               "VDG_MANOSFERA_ANTIFEMINISMO", "VDG_SALVAGUARDA_FALSO_POSITIVO", "VDG_DESACREDITACION_ACTIVISTAS", "ninguna"]
SEVERITY_RANK = {"ninguna": 0, "baja": 1, "media": 2, "alta": 3}
MAX_LABELS = 5

CODES = [c[0] for c in CATEGORIES]
LABELS = {c[0]: c[1] for c in CATEGORIES}
DIMENSIONS = {c[0]: [d for d, _ in c[3]] for c in CATEGORIES}
ALL_DIMENSIONS = [d for c in CATEGORIES for d, _ in c[3]]

# Words of aggression without gender bias, and words that mark gender bias.
AGGRESSION = ["idiota", "imbecil", "estupido", "mierda", "carajo", "joder", "maldito", "maldita", "basura", "inutil", "huevon",
              "boludo", "pelotudo", "forro", "giles", "gil", "de mierda", "ctm", "ptm", "hdp", "hijueputa", "hp", "pendejo", "pendeja"]
GENDER_MARKERS = ["feminazi", "foid", "femoid", "mangina", "incel", "mgtow", "redpill", "red pill", "pastilla roja", "hembrista",
                  "zorra", "puta", "perra", "guarra", "cosificar", "matar", "violar", "violacion", "violación", "femicidio",
                  "mujeres de cocina", "solo sirven", "para eso estas", "para eso estás"]

# Laughter and short reactions, matched against the whole normalised text.
TAIL = r"[!¡¿?.,\s]*"
LAUGHTER = ["(ja){2,}", "(je){2,}", "(ji){2,}", "(ha){2,}", "(he){2,}", "(rs){2,}", "(lol)+", "(lmao)+", "(xd)+", "(ajaj+)(ja)*", "(jaj)+(aj)*"]
REACTIONS = ["ok", "dale", "va", "ya", "si", "no", "je", "ah", "oh", "eh", "uf", "uy", "sep", "obvio", "claro", "exacto", "pues", "se", "que",
             "qui(s|z)a(s|z)?", "a ver", "aver", "tal", "cual", "quien", "como", "donde", "cuando", "tambien", "tampoco", "vale", "venga",
             "ahi", "aqui", "alla", "aca"]
REACTIONS_SHORT = ["q[!.?]?", "k[!.?]?"]

# Keyword buckets of the rule classifier, in order: name, category, dimension, severity, score, words, needed context.
BUCKETS = [
    ("amenaza_muerte", "VDG_HOSTILIDAD_FEMINICIDIO", "3.2", "alta", 3, ["matar", "mu3rt", "m4tar", "asesinar", "asesin4r", "morir", "muere"], []),
    ("agresion_fisica", "VDG_HOSTILIDAD_FEMINICIDIO", "3.1", "alta", 3, ["golpe", "pegar", "agredir", "herida", "moreton", "moretón", "pego", "golpea", "pega"], []),
    ("insulto_sexual", "VDG_COSIFICACION_SLUTSHAMING", "2.3", "media", 2, ["zorra", "puta", "perra", "guarra", "cualquiera", "promiscua"], []),
    ("amenaza_general", "VDG_HOSTILIDAD_FEMINICIDIO", "3.1", "media", 2, ["amenaza", "amenazar", "te voy a"], []),
    ("sexual_explicito", "VDG_COSIFICACION_SLUTSHAMING", "2.1", "alta", 3, [
        "violacion", "violación", "abuso", "acoso sexual", "violar", "cosificar", "cosificacion", "cosificación", "para eso estás", "para eso estas",
        "mostrá las tetas", "mostrame las tetas", "si no accedés es tu culpa", "si no accedes es tu culpa"], []),
    ("psicologica", "VDG_VIOLENCIA_SIMBOLICA", "1.2", "media", 2, [
        "no sos nada", "no eres nada", "no sirves para nada", "estas loca", "estás loca", "me volves loco", "me volvés loco", "sin mi no vales",
        "sin mí no vales", "manipul", "controlar", "humill"], []),
    ("estereotipo", "VDG_VIOLENCIA_SIMBOLICA", "1.1", "baja", 1, ["solo sirven", "de cocina", "las mujeres", "los hombres no", "rol de genero", "rol de género"], []),
    ("control_economico", "VDG_VIOLENCIA_SIMBOLICA", "1.2", "media", 2, ["no te doy plata", "no te doy dinero", "no trabajas", "soy yo el que mantiene"], []),
    ("vicaria", "VDG_HOSTILIDAD_FEMINICIDIO", "3.1", "alta", 3, ["le hago dano a los hijos", "le hago daño a los hijos", "le pego al perro", "le pego al gato"], []),
    ("manosfera_subculturas", "VDG_MANOSFERA_ANTIFEMINISMO", "4.1", "media", 2, ["mra", "mgtow", "pua", "incel", "red pill", "redpill", "black pill", "beta"], []),
    ("manosfera_victimismo", "VDG_MANOSFERA_ANTIFEMINISMO", "4.1", "media", 2, [
        "hipergamia", "geneticamente programada", "genéticamente programada", "interesadas", "gold digger", "interés material"], []),
    ("manosfera_antifeminista", "VDG_MANOSFERA_ANTIFEMINISMO", "4.2", "media", 2, [
        "feminazi", "hembrista", "misandria", "ideologia de genero", "ideología de género", "criminalizan al hombre", "criminalizan a los hombres"], []),
    ("manosfera_emasculacion", "VDG_MANOSFERA_ANTIFEMINISMO", "4.3", "media", 2, [
        "aliade", "mangina", "pagafantas", "huelebragas", "calzonazos", "blandengue", "parguelón"], []),
    ("manosfera_arquetipos", "VDG_MANOSFERA_ANTIFEMINISMO", "4.4", "media", 2, ["foid", "femoid", "stacy", "tradwives", "teamalienadas", "team alienadas"], []),
    ("desacreditacion_activistas", "VDG_DESACREDITACION_ACTIVISTAS", "5.1", "media", 2, [
        "feminista radical", "feministas radicales", "feminismo radical", "traumada", "ardida", "histéricas", "histericas", "exageradas",
        "buscan atención", "buscan atencion", "tóxicas", "toxicas"], []),
    ("ridiculizacion_activistas", "VDG_DESACREDITACION_ACTIVISTAS", "5.2", "media", 2, [
        "váyanse a lavar", "vayanse a lavar", "a la cocina", "limpien sus casas", "cuiden a sus hijos", "váyanse a dormir", "vayanse a dormir",
        "viejas webonas", "ridículas", "ridiculas", "pónganse a trabajar", "ponganse a trabajar"],
     ["activista", "feminista", "manifestante", "marcha", "protesta", "periodista", "política", "politica", "8m", "colectivo"]),
    ("micromachismo", "VDG_SALVAGUARDA_FALSO_POSITIVO", "6.1", "baja", 1, [
        "calladita te ves más bonita", "calladita te ves mas bonita", "tenías que ser mujer", "tenias que ser mujer"], []),
    ("humor_hostil", "VDG_SALVAGUARDA_FALSO_POSITIVO", "6.2", "media", 2, ["jajaja", "jajaja", "jaja", "es solo humor", "era una broma"], []),
]

# Words and phrases of pages that ask for a login or show a captcha.
LOGIN_MARKS = ['name="email"', 'name="pass"', 'id="login_form"', 'autocomplete="current-password"', 'class="_9ay7"', 'aria-label="iniciar sesión"']
CAPTCHA_MARKS = ['name="captcha_response"', 'id="captcha"', "checkpoint/checktest", "security_check_challenge",
                 "por favor, completa el siguiente control de seguridad", "please complete the following security check"]
SOCIAL_DOMAIN = "facebook.com"
