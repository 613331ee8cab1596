"""Word lists, patterns and tables that results depend on, as given."""

#: Topic tags and the patterns (on lower-case text) that set them, in order.
TOPIC_PATTERNS = {
    "vo2max": [r"vo2\s*max", r"oxygen consumption", r"consumo.*ox[íi]geno", r"aerobic fitness"],
    "hrv_rmssd": [r"hrv\b", r"rmssd", r"heart rate variability", r"variabilidad.*card[íi]aca", r"r-r interval"],
    "epoc": [r"epoc\b", r"excess post-exercise", r"training effect", r"efecto.*entrenamiento"],
    "sleep": [r"sleep", r"sueño", r"rem\b", r"slow-wave", r"deep sleep", r"sueño profundo"],
    "stress": [r"stress", r"estr[ée]s", r"body battery", r"sympathetic", r"parasympathetic", r"auton[oó]mic"],
    "ppg_sensor": [r"elevate", r"photoplethysmograph", r"fotopletismograf", r"led", r"optical sensor", r"sensor [oó]ptico"],
    "calories": [r"calor[íi]a", r"calorie", r"energy expenditure", r"gasto cal[oó]rico", r"bmr\b"],
    "respiration": [r"respiration", r"respiraci[oó]n", r"brpm", r"rsa\b", r"ventilatory"],
    "spo2": [r"spo2", r"pulse ox", r"pulsioximetr[íi]a", r"saturaci[oó]n.*ox[íi]geno", r"hypoxia"],
}

#: Leet signs and the letters they stand for, position by position.
LEET_SIGNS, LEET_LETTERS = "@431!05$7+", "aaeiiosstt"

#: Attack families in the order in which they are tried; Java and RE2 read them alike.
ATTACK_PATTERNS = {
    "SYNTAX_INJECTION": r"(?i)(?:<\|im_start\|>|<\|im_end\|>|\[INST\]|\[/INST\]|<<SYS>>|</SYS>|###\s*(?:System|Instruction|Assistant):)",
    "INSTRUCTION_OVERRIDE": r"(?is)(?:olvida|ignora|omite|desecha|override|ignore|disregard|forget|bypass).*?(?:instrucciones|indicaciones|directrices|reglas|prompts?|instructions?|rules?|guidelines?|system\s*prompt)|(?:system\s*prompt\s*override|override\s*system\s*prompt|system\s*override)",
    "ROLEPLAY_JAILBREAK": r"(?i)\b(?:actua|comportate|responde|pretend|act|behave)\s+(?:como|as)\s+(?:un\s+)?(?:.*?)?(?:dan|ia\s+libre|modelo\s+desbloqueado|sin\s+restricciones|sin\s+filtros|unrestricted|root|jailbreak)\b|\b(?:developer\s+mode|modo\s+desarrollador|modo\s+dan|dan\s+mode|do\s+anything\s+now|jailbroken|godmode)\b",
    "PROMPT_LEAK": r"(?is)\b(?:revela|muestra|imprime|repite|dime|show|print|reveal|repeat|dump)\b.*?\b(?:system\s*prompt|instrucciones\s+del\s+sistema|texto\s+anterior|tus\s+instrucciones|hidden\s+prompt)\b",
    "HYPOTHETICAL_BYPASS": r"(?is)\b(?:en\s+un\s+mundo\s+hipotetico|para\s+una\s+historia\s+ficticia|in\s+a\s+hypothetical\s+universe)\b.*?\b(?:sin\s+reglas|no\s+tienes\s+filtros|sin\s+restricciones|without\s+restrictions)\b",
}

#: Terms of the domain (brand names are given by the caller).
DOMAIN_TERMS = [
    "rmssd", "vfc", "hrv", "vo2", "vo2max", "lactato", "estres", "pulsaciones", "frecuencia cardiaca", "cadencia", "potencia",
    "body battery", "tiempo de recuperacion", "sueno profundo", "sueno", "fase rem", "entrenamiento", "ritmo cardiaco", "pulsometro",
    "spo2", "epoc", "training effect", "elevate", "running dynamics", "umbral anaerobico", "recuperacion", "descanso", "cardiovascular", "rhr",
]

#: Words that tell Spanish, English and other languages.
SPANISH_WORDS = (
    "el la los las un una unos unas de del en para por con sin sobre como que cual cuando donde porque mi mis tu tus su sus esta este esto estos estas "
    "es son fue muy mas menos pero sueno frecuencia cardiaca estres recuperacion entrenamiento bajo baja alto alta cuerpo descanso pulsaciones ritmo horas noche dia semana reloj"
).split()
ENGLISH_WORDS = (
    "the a an is are was were be been being have has had do does did will would should can could of in to for with on at from by about as into what how why when where which who "
    "my your his her its our their sleep heart rate deep stages stress recovery training affect improve work night watch battery"
).split()
FOREIGN_WORDS = (
    "comment puis-je ameliorer sommeil avec dans votre etre tres pourquoi wie warum schlaf verbessert mein meine nicht kann bitte "
    "posso melhorar meu sono voce nao qualquer migliorare sonno perche nostro vostro"
).split()

#: Short query tokens that count in spite of their length.
SHORT_TOKENS = ["hr", "hf", "lf", "rr"]

#: Vernacular markers of a good answer.
MARKERS = {
    "es": ["carnal", "mi rey", "machín", "al tiro", "chamba", "paliza", "máquina", "pila", "chingón", "a darle"],
    "en": ["my friend", "engine", "dialed in", "get after it", "beast mode", "barbell", "track", "work"],
}
