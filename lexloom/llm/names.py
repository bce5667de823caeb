"""Given names and their short forms, shared by name matching and the search for personal data."""

#: Full given names with common short forms (English, German, French, Spanish usage).
SHORT_FORMS = {
    "abigail": "abby",
    "alexander": "alex sandy sasha",
    "amadou": "",
    "amanda": "mandy",
    "andrew": "andy drew",
    "anna": "annie",
    "anselm": "",
    "anthony": "tony",
    "barbara": "barb",
    "benjamin": "ben benny",
    "catherine": "cathy",
    "charles": "charlie chuck carlos",
    "christine": "chris tina",
    "christopher": "chris kit",
    "daniel": "dan danny",
    "david": "dave",
    "deborah": "deb debbie",
    "dolores": "lola",
    "donald": "don donny",
    "dorothea": "dora thea dorothy",
    "edward": "ed eddie ted ned",
    "elizabeth": "liz beth lisa eliza betty",
    "francisco": "paco pancho",
    "frederic": "fred freddy",
    "friedrich": "fritz",
    "gabriela": "gabi gaby",
    "george": "",
    "gerald": "gerry",
    "gregory": "greg",
    "greta": "",
    "hedda": "",
    "henry": "harry hank",
    "ignacio": "nacho",
    "ingrid": "inga",
    "isabelle": "isa belle",
    "jacob": "jake",
    "james": "jim jimmy",
    "jeffrey": "jeff",
    "jennifer": "jen jenny",
    "jessica": "jess",
    "johannes": "hannes hans",
    "john": "jack johnny",
    "jonathan": "jon",
    "jose": "pepe",
    "joseph": "joe",
    "josephine": "jo josie",
    "joshua": "josh",
    "karl": "",
    "katherine": "kathy kate katie",
    "kenneth": "ken kenny",
    "kofi": "",
    "lawrence": "larry",
    "leonard": "len leo lenny",
    "linnea": "",
    "margaret": "maggie meg peggy",
    "maria": "",
    "matthew": "matt",
    "michael": "mike mick",
    "miriam": "mimi miri",
    "nathalie": "nat natty",
    "nathaniel": "nate",
    "nicholas": "nick nicky",
    "noemi": "mimi",
    "omar": "",
    "pamela": "pam",
    "patricia": "pat trish patty",
    "peter": "pete",
    "philip": "phil",
    "pierre": "",
    "priya": "",
    "raymond": "ray",
    "rebecca": "becky",
    "renate": "",
    "richard": "rich rick dick",
    "robert": "rob bob bobby",
    "ronald": "ron ronnie",
    "samuel": "sam sammy",
    "sofia": "sophie",
    "stephen": "steve",
    "susannah": "sue susie susan",
    "thaddeus": "tad thad",
    "theresa": "tess terry resi",
    "thomas": "tom tommy",
    "timothy": "tim timmy",
    "tomas": "",
    "victoria": "vicky tori",
    "vincent": "vince",
    "walter": "walt",
    "wilhelmina": "mina willa minna",
    "william": "will bill billy",
    "yusuf": "",
    "zachary": "zach",
}
FULL_OF: dict[str, frozenset[str]] = {}
for _full, _short in SHORT_FORMS.items():
    for _name in (_full, *_short.split()):
        FULL_OF[_name] = FULL_OF.get(_name, frozenset()) | {_full}
#: Further common given names (English, German, French, Spanish, Italian and others). They are weak evidence only:
#: the search in texts finds names in no table by their shape and the words around them.
COMMON = frozenset(
    """adrian adriana ahmed alejandro alessandro alfred ali alice alicia amanda amelia andrea andreas angela angelo antoine antonio arthur astrid
    barbara beatrice beatriz bernard brenda bruno camille carla carlos carmen carolina caroline cecilia charlotte chen christian christopher claire
    claudia claudio cristina daniela deborah denise diana diego dieter dominique donald eduardo elena elisabeth emily emma enrico enrique erika ernst
    eva fatima felipe felix fernando florian francesca francesco francois frank franziska gerhard giovanni giulia giuseppe gregory guillaume hannah
    hans hassan heike heinrich helen helene helmut herbert hugo ibrahim isabel jacques jan janet javier jean jennifer jessica joan jonas jonathan jorge
    joshua juan julia julian karen karin kenneth kevin klaus laura laurent linda louis louise lucas lucia luigi luis lukas manuel marco marcus marie mario
    mark marta martin mary matteo matthias melissa miguel mohammed monica monika muhammad nadia nancy natalia nicholas nicolas nicole olga oliver olivier
    pablo paolo pascal patrick paul paula pedro philip philippe rachel rafael rebecca ricardo roberto roland ruth sabine samantha sandra sarah
    sebastian sergio silvia simon simone stefan stephanie steven susanne sylvie thierry timothy ursula valentina veronica vincent walter wei
    werner wolfgang yvonne""".split()
)
