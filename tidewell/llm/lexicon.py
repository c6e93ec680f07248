"""Word classes, strengths, phrases and clauses of the grammar for abusive language, for English, Spanish,
German, Dutch and Catalan. All words are without accents and in lower case."""

# The words of each class.
LEXICON = {
    "YOU": "you u ya yous youre ur du dich dir euch ihr jij je jou jullie tu ti te vos usted ustedes vosotros os et vosaltres voste",
    "YOUR": "your ur dein deine deinen deiner deinem euer eure jouw je jullie tu tus vuestra vuestro teu teva teus teves",
    "ME": "me my i im we mir mich ich wir uns mij ik wij ons mi yo nosotros jo em nosaltres",
    "THEY": "they them their theyre those these sie ihnen ihre solche alle ze zij hen hun zulke ellos ellas esos esas estos les los las ells elles aquests aquells tots",
    "SLUT": "sluts slut whores whore bitches girls chicks babes ladies milfs women teens chicas putas zorras mujeres chochos schlampen schlampe huren hure frauen madels girls weiber sletten slet hoeren meiden vrouwen wijven noies putes dones meuques",
    "HOT": "hot horny naked nude wet dirty naughty sexy slutty calientes caliente cachondas cachonda desnudas geile geilen geiler nackte heisse heiss versaute hete natte naakte calentes calenta nues despullades",
    "SEXPART": "cock cocks dick dicks tits tit boobs pussy ass arse cunt clit balls butt nipples tetas polla cono culo verga pene titten schwanz muschi arsch fotze mose brust tieten kut lul kont pik borsten tetes polla cony cul pits figa",
    "NUDE": "nudes nude nacktbilder nacktfotos naaktfoto naaktfotos desnudos nus despullats",
    "PORN": "porn porno xxx pornos pornography nsfw",
    "MEDIA": "pics pic photos photo pictures clips clip videos video cam webcam bilder bild fotos foto beelden filmpjes filmpje plaatjes imagenes fotografies imatges",
    "BARE": "naked nude undressed topless desnuda desnudo nackt nackte nacktes naakt nua despullada",
    "HORNY": "horny randy aroused cachondo cachonda geil spitz calent calenta catxonda",
    "BE": "are re is r be was were bist ist seid sind ben bent is zijn eres es sois son sos ets es sou son been being",
    "HE": "he she it hes shes er sie es el ella hij zij ze who whoever everyone der die wer quien qui wie",
    "KIN": "brother sister mother mum mom father dad son daughter wife husband boss chef jefe cap baas teacher neighbour neighbor friend brud bruder schwester mutter vater frau mann moeder vader broer zus baas vriendin madre padre hermano hermana esposa mare pare germa dona driver clerk mayor captain skipper guy man woman kerl typ tio vent mens",
    "DET": "a an the such one of that this ein eine einen einem einer der die das den so dieser diese dieses een de het zo die dat un una el la los las les unos unas uno ese esa este els les l aquest aquesta",
    "VERY": "so very really such total totally complete completely absolute absolutely fucking bloody damn goddamn just nothing but only always utterly still too muy tan total absolut absoluter vollig echt ganz so zu zeer heel erg wel te molt tan ben massa completament demasiado",
    "INSULT": "idiot moron imbecile cretin loser scumbag bastard asshole arsehole prick dickhead wanker twat cunt coward liar clown fool jerk bitch whore slut swine pig dumbass jackass dimwit halfwit nitwit retard creep pervert tosser douchebag motherfucker sucker scum weasel maggot cow hag witch crook lowlife degenerate "
    "idiota imbecil inutil cabron desgraciado payaso gilipollas cretino estupido tonto capullo mamon cerdo cerda puta zorra subnormal asqueroso cobarde canalla pendejo hijoputa malnacido fracasado mentirosa mentiroso "
    "trottel feigling versager drecksack arschloch vollidiot depp schwein hurensohn wichser mistkerl dummkopf schlampe penner lugner missgeburt spast hure blodmann dreckschwein fotze miststuck "
    "klootzak lul eikel idioot mislukkeling lafaard sukkel trut hoer teef kutwijf hufter randdebiel mongool nietsnut smeerlap debiel leugenaar "
    "desgraciat malparit cabro fillde covard capsigrany porc porca fracassat brut ximple burro tros merdos pallasso meuca",
    "FOUL": "stupid dumb useless worthless pathetic brainless spineless rotten filthy disgusting ugly fat miserable lousy dirty vile sick twisted shitty crappy stinking nasty gutless clueless smelly slimy lazy lying hideous repulsive incompetent greedy "
    "asqueroso asquerosa sucio sucia feo fea gordo gorda maldito maldita puto puta jodido patetico patetica repugnante mentirosa miserable inutil estupida "
    "dumm dumme dummer dummes blod bloder blode widerlich widerliche widerlicher fett fette fetter hasslich hassliche dreckig dreckige dreckiger verdammt verdammter verdammtes elender elende armseliger armselig erbarmlicher erbarmlich nutzloser nutzlose "
    "achterlijke achterlijk domme dom vieze vuile stomme smerige lelijke waardeloze zielige laffe dikke lamme "
    "fastigos fastigosa brut bruta lleig lletja gras grassa maleit punyeter patetic repugnant",
    "WASTE": "waste piece bag sack pile lump stuck trozo pedazo tros stuk",
    "DIRT": "shit crap skin space air oxygen filth dirt garbage trash dung scheisse dreck stront mierda merda",
    "TRASH": "trash garbage failure disgrace filth rubbish basura mierda abschaum rotzak uitschot escoria brossa",
    "HUSH": "mouth trap gob face hole fresse schnauze maul klappe bek kop smoel boca pico",
    "DIE": "die drown burn rot choke suffer bleed starve perish croak hang ahogues mueras pudras quemes revientes verreck verrecke verreckst ersaufst ersauf stirbst stirb ertrinkst krepier krepiere krepierst verdrink verzuip verdrinkt sterf sterft stik crepeer krepeer verrot ofega ofeguis moris podreixis moriu rebentis cremis muere muerete",
    "KILL": "kill murder butcher slaughter strangle shoot stab slit gut hurt beat break smash punch slap crush choke skin cut hit knife destroy rape bash batter partir romper reventar rajar quemar matar ahogar degollar schlagen toten brechen erschiessen umbringen slaan breken schoppen vermoorden exterminate gas lynch drown hang deport vergasen matar trencar rebentar",
    "MYKILL": "mato matare parto partire rompo rompere reviento reventare rajo rajare quemo quemare ahogo degollo schlage schlag tote breche brech erschiesse steche verbrenne ersaufe bringe bring sla breek schop steek vermoord verbrand wurg snijd maak trenco trencare mato matare rebento rebentare cremo ofego tallo",
    "BODY": "face legs leg teeth throat neck head skull bones ribs arms knees jaw nose fingers cara piernas dientes cuello cabeza huesos boca craneo gesicht beine zahne hals kopf knochen fresse schadel tanden benen nek strot kop botten gezicht cames dents cara coll cap ossos boca",
    "THINGS": "car house home tyres family kids children dog boat shop window windows door doors flat haus auto boot huis kinderen casa coche hijos familia cotxe fills",
    "WEAPON": "bat knife gun axe hammer club crowbar machete rifle cuchillo pistola bate messer knuppel baseballschlager waffe mes pistool honkbalknuppel ganivet",
    "COME": "come coming visit show komme komm kom komen voy vamos vinc find finde vind",
    "LIVE": "live lives park work works sleep sleeps drink go goes wohnst wohnt arbeitest woont woon werkt vives vive trabajas vius treballes breathe exist",
    "HURT": "slapped shot hanged beaten drowned whipped kicked punched hung flogged stoned gassed exterminated wiped eradicated executed castrated caged burned burnt lynched deported expelled shut vergast erschossen geschlagen verbrannt erhangt eliminados fusilados expulsados quemados afgeschoten opgehangen afusellats",
    "LEFT": "thrown left leave dumped dejarla dejarlo dejarlos geworfen liggen verdrinken ertrinken deixar deixarla deixarlo llencar tirar tirarla tirarlo lie drown",
    "OUGHT": "should ought must deserve deserves belong needs hay habria habrias tendria tendrian merecen merece sollte sollten soll muss mussen gehoren gehort verdienen verdient moet moeten horen caldria cal hauria haurien mereixen",
    "MIGHT": "will ll would gonna shall going might ill voy vamos werde werden ga gaan zal zullen vaig",
    "HOPE": "hope wish pray ojala espero deseo hoffe hoffentlich wunsche hoop hopelijk wens tant espero desitjo",
    "PEOPLE": "foreigners foreigner refugees refugee newcomers newcomer migrants migrant immigrants immigrant strangers outsiders women gays lesbians jews muslims christians blacks gypsies asians africans arabs southerners northerners easterners westerners islanders beggars homeless cripples "
    "refugiados forasteros extranjeros inmigrantes mujeres moros gitanos judios negros musulmanes gentuza sudacas maricones "
    "neuen fremden fluchtlinge auslander juden frauen zigeuner muslime migranten zuwanderer asylanten schwulen "
    "vreemden nieuwen nieuwkomers vluchtelingen vrouwen buitenlanders joden moslims migranten homos "
    "forasters nouvinguts refugiats estrangers dones jueus gitanos immigrants musulmans",
    "FOLK": "people folk leute menschen mensen lui gente gent ones kind lot sort",
    "FOLKOF": "old elderly river valley hill island poor disabled alten alte ouderen viejos vells",
    "VERMIN": "rats rat vermin parasites parasite plague cockroaches cockroach roaches animals subhumans subhuman lice leeches pests pest maggots disease cancer scum filth trash garbage dogs pigs swine beasts monkeys apes savages locusts insects "
    "ratas rata plaga parasitos parasito basura animales cucarachas escoria chusma alimanas bestias cerdos perros peste "
    "ungeziefer schmarotzer parasiten ratten abschaum dreck tiere untermenschen pack gesindel schadlinge kakerlaken seuche pest viecher schweine "
    "ongedierte ratten parasieten tuig uitschot beesten plaag kakkerlakken profiteurs varkens "
    "rates parasits parasit plaga escoria bestioles animals paneroles brossa xusma porcs gossos",
    "CRIME": "thieves criminals rapists terrorists murderers liars diebe verbrecher kriminelle terroristen ladrones criminales violadores dieven criminelen lladres",
    "RUIN": "ungluck untergang verderben ruin downfall curse misfortune perdicion ruina ondergang",
    "EXPEL": "ship throw kick drive chase hunt deport expel send boot gooi gooit smijt jaag jaagt trap schop werft wirf jagt jag treibt schickt schmeisst expulsar echar foragitar expulseu tirad echad fer feu",
    "EXPELTHEM": "echarlos echarlas expulsarlos expulsarlas matarlos quemarlos ahogarlos ferlos foragitarlos expulsarlos",
    "OUT": "off out away back raus weg fort eruit uit zuruck heraus hinaus fuera fora enfora",
    "RAUS": "raus fuera fora weg out",
    "HELP": "help rescue save feed house shelter trust hire",
    "SPEND": "waste spend throw wasting spending",
    "BREED": "breed breeds multiply multiplies vermehren fokken reproducen",
    "HOSTEL": "hostel hostels shelter shelters camp camps mosque mosques synagogue synagogues heim moschee synagoge mezquita sinagoga asielcentrum moskee mesquita",
    "FIRE": "burn torch bomb firebomb raze anzunden abfackeln quemar incendiar platbranden cremar",
    "SEXVERB": "fuck fucks fucked fucking suck sucks sucked sucking bang banging ride riding lick licks licked licking screw shag blow cum spank hump finger follar chupar chuparte chupo mamar lamer coger tirarme follarte ficken blasen bumsen lecken vogeln lutschen poppen neuken pijpen likken beffen zuigen cardar follar mamar llepar xuclar chupar",
    "WANT": "want wanna need would like love let gonna going will quiero quieren quiere quisiera wollen willst mochte wil willen zou vull volen vol voldria",
    "ACT": "send show see watch want buy get trade swap click schick schicke zeig zeige stuur laat mandame mandam enviame enviam pasame ensename envia ensenyam",
    "THINK": "think believe mean say said saying claim claimed creo pienso digo crec penso dic glaube denk",
    "REPORTED": "said wrote written shouted yelled screamed called calls painted sprayed posted read reads condemned reported accused quoted quotes complained overheard alleged testified insult insulted slur comment word dijo escribio grito llamo pintaron insulto sagte schrieb rief nannte beschimpfte stand zei schreef riep noemde beledigde digue escrigue crida pintada insultar",
    "PUTA": "puta puto bitch hure perra whore",
    "OFFICE": "police council court judge prosecutor committee mayor ministry moderators report article film novel play word policia juez alcalde ayuntamiento polizei gericht rat politie rechter gemeente ajuntament jutge",
    "NOT": "not no never nobody without dont nicht kein keine keinen nie niemand niet geen nooit nadie nunca ningun ninguna jamas cap mai ningu isnt arent wont wouldnt",
}

#: What a word of a class adds to a phrase or clause; other classes add nothing.
STRENGTH = {
    "INSULT": 1.0, "PUTA": 1.0, "FOLK": 0.2, "FOUL": 0.4, "DIRT": 0.7, "TRASH": 0.5, "DIE": 0.8, "KILL": 0.5, "MYKILL": 0.6, "BODY": 0.5, "THINGS": 0.4, "WEAPON": 0.5, "HURT": 0.6, "LEFT": 0.4, "PEOPLE": 0.2, "FOLKOF": 0.2,
    "DEMONYM": 0.2, "NAME": 0.1, "VERMIN": 0.8, "CRIME": 0.6, "RUIN": 0.7, "EXPEL": 0.5, "EXPELTHEM": 0.7, "HELP": 0.2, "BREED": 0.3, "HOSTEL": 0.4, "SEXPART": 0.5, "SEXVERB": 0.5, "SLUT": 0.3, "HOT": 0.4, "NUDE": 0.7, "BARE": 0.5, "HORNY": 0.6, "PORN": 0.6, "MEDIA": 0.3, "HOPE": 0.2,
}

_OTHER = {
    ("INSULT", 0.6): "fool clown liar coward jerk pig crook cow witch hag sucker payaso tonto cobarde mentiroso mentirosa burro brut feigling lugner lafaard leugenaar pallasso covard penner weasel",
    ("FOUL", 0.6): "stupid dumb worthless pathetic brainless disgusting ugly useless spineless repulsive hideous asqueroso asquerosa estupida patetico widerlich widerlicher widerliche hasslich dumm domme achterlijke fastigos fastigosa fat rotten filthy",
    ("VERMIN", 0.6): "animals dogs monkeys pigs rats plague disease trash garbage cancer pest plaga peste basura perros animales tiere dreck pack seuche plaag brossa porcs gossos apes insects beasts",
    ("KILL", 0.9): "kill murder butcher slaughter exterminate lynch matar toten umbringen vermoorden vergasen",
    ("KILL", 0.8): "stab shoot hang gas deport strangle drown erschiessen",
    ("KILL", 0.7): "hurt slit gut rape bash batter",
    ("KILL", 0.3): "cut hit beat",
    ("MYKILL", 0.9): "mato matare tote erschiesse vermoord",
    ("MYKILL", 0.2): "bringe bring maak",
    ("DIE", 0.5): "burn hang suffer bleed",
    ("EXPEL", 0.3): "send fer feu echar",
    ("DIRT", 0.4): "space air oxygen skin",
    ("LEFT", 0.3): "left leave lie",
    ("SLUT", 0.1): "girls chicks babes ladies teens women chicas mujeres frauen madels meiden vrouwen noies dones weiber wijven",
    ("SEXPART", 0.3): "ass arse cock cocks balls butt brust lul kut pits arsch cul culo kont",
    ("HOT", 0.2): "hot wet dirty caliente calientes heiss heisse hete natte calenta calentes sexy",
}
WORD_STRENGTH = {(c, w): s for (c, s), words in _OTHER.items() for w in words.split()}

#: A sentence without a word of these classes, or one of these words, cannot hold a clause.
ANCHORS = {"INSULT", "FOUL", "WASTE", "TRASH", "DIE", "KILL", "MYKILL", "WEAPON", "HURT", "LEFT", "VERMIN", "CRIME", "RUIN", "EXPEL", "EXPELTHEM", "RAUS", "BREED", "FIRE", "SEXPART", "SEXVERB", "HORNY", "PORN", "NUDE", "BARE", "HELP", "HUSH", "PEOPLE", "DEMONYM", "ashamed", "pay", "miss", "loss", "without", "kitchen", "spend", "SLUT", "MEDIA", "PUTA", "fire"}
#: Of these, the ones that need nobody else; a sentence with the others alone needs a PARTNER too.
STRONG = {"INSULT", "FOUL", "TRASH", "VERMIN", "RUIN", "EXPELTHEM", "RAUS", "SEXPART", "SEXVERB", "HORNY", "PORN", "NUDE", "BARE", "PUTA", "SLUT", "HUSH", "WEAPON"}
PARTNERS = {"YOU", "YOUR", "THEY", "PEOPLE", "DEMONYM", "FOLK", "FOLKOF", "HOSTEL", "yourself", "yourselves", "urself"}

#: Levels of phrases: the symbol and what it consists of; the leftmost longest reading holds.
PHRASES = [
    [
        ("INS", "DET VERY* FOUL* INSULT"), ("INS", "DET VERY* FOUL* INSULT and|und|en|y|i DET? FOUL* INSULT"), ("VOC", "VERY* FOUL* INSULT"),
        ("INS", "DET VERY* FOUL* INSULT of|de|von|van|aus DIRT"), ("VOC", "VERY* FOUL* INSULT of|de|von|van|aus DIRT"), ("INS", "DET VERY* FOUL* WASTE of|de|von DIRT"), ("VOC", "FOUL* WASTE|TRASH of|de|von DIRT"),
        ("INS", "DET VERY* FOUL+ TRASH"), ("VOC", "VERY* FOUL INSULT FOUL"), ("INS", "DET INSULT FOUL"), ("VOC", "hijo|hija|fill|filla|son|sohn de|of|einer DET? PUTA|INSULT"),
        ("INS", "DET hijo|hija|fill|filla|son de|of DET? PUTA"), ("INS", "un|una fill|filla|hijo|hija de PUTA"),
        ("FOULP", "VERY* FOUL"), ("FOULP", "VERY* FOUL and|und|en|y|i VERY* FOUL"),
        ("GROUP", "all|alle|todos|tots? DET|those|these|los|las|diese? FOUL* PEOPLE"), ("GROUP", "all|alle|todos|tots DET? DEMONYM|NAME"), ("GROUP", "DET|los|las? DEMONYM"), ("GROUP", "DET|los|las|those|these NAME"), ("GROUP", "FOUL* PEOPLE"),
        ("GROUP", "FOLKOF FOLK"), ("GROUP", "DET|those|these|such|solche|zulke|esa|aquesta FOLKOF? FOLK"), ("GROUP", "FOLK like|wie|als|como|com DET|those|these|los? PEOPLE|DEMONYM|NAME|THEY"), ("GROUP", "FOLK like|wie|als|como|com DET|those|los? FOLKOF FOLK"),
        ("GROUP", "their|seine|ihre|su|hun FOLK"), ("GROUP", "los|die|de|els FOLKOF"),
        ("YOULIKE", "such|solche|zulke|DET? FOLK|those|solche|someone like|wie|als|como|com YOU"), ("YOULIKE", "solche|zulke wie|als YOU"),
        ("VERM", "DET? VERY* FOUL* VERMIN"), ("VERM", "DET? VERY* FOUL* VERMIN and|und|en|y|i DET? FOUL* VERMIN"),
        ("BODYP", "YOUR FOUL* BODY"), ("LABODY", "DET|las|los|les|els|l|dir|die|die BODY"), ("THINGP", "YOUR FOUL* THINGS"),
        ("SEXP", "YOUR|ME|his|her|su|sus|tus|tes|mi|DET? HOT|FOUL|hard* SEXPART"), ("SEXP", "YOUR|ME|his|her|DET HOT? BARE|HOT body|bodies"),
    ],
    [
        ("GROUP", "GROUP of|in|from|aus|de|van|d NAME|DEMONYM"), ("BEHURT", "be|get|being HURT out|off|up|down?"), ("BEHURT", "HURT werden|worden|gehoren"), ("BEHURT", "kicked|thrown|driven|shipped OUT"),
        ("HARM", "KILL BODYP|THINGP in|off|out?"), ("HARM", "KILL YOU up?"), ("HARM", "KILL YOU in|on DET LABODY|BODY"), ("HARM", "te|et|us|os|dir|dich|je|jou MYKILL LABODY"), ("HARM", "MYKILL dir|dich|je|jou|euch LABODY|BODYP|BODY"), ("HARM", "MYKILL je BODY"), ("HARM", "MYKILL BODYP|THINGP in|off|eraf|eruit|kapot?"),
        ("HARM", "te|et|us|os voy|vamos|vaig a? KILL LABODY"), ("HARM", "bring|bringe YOU um"), ("HARM", "MYKILL YOU af|dood|kapot|tot|um"), ("HARM", "KILL LABODY a? YOU"), ("HARM", "te|et|us|os MYKILL"),
        ("EXPELP", "EXPEL a|als|los|las|els|GROUP? GROUP|THEY back? OUT"), ("EXPELP", "EXPEL GROUP|THEY _{0,3} OUT"), ("EXPELP", "EXPEL OUT GROUP|THEY"),
    ],
]

#: Clauses: category, base weight, pattern over phrases and words; END is the end of the sentence.
CLAUSES = [
    # insults with a target
    ("abusive", 0.4, "YOU BE? VERY* INS|VOC"), ("abusive", 0.4, "BE YOU VERY* INS|VOC"), ("abusive", 0.4, "eres|ets|sois|sou VERY* INS|VOC"), ("abusive", 0.4, "YOU BE FOULP"), ("abusive", 0.4, "youre FOULP"), ("abusive", 0.4, "eres|ets|sois|sou FOULP"),
    ("abusive", 0.4, "INS|VOC like|como|wie|als|com YOU"), ("abusive", 0.4, "INS|VOC YOU BE"), ("abusive", -0.1, "what|que|was|quin|wat INS|VOC"), ("abusive", 0.3, "what|que|was|quin|wat INS|VOC YOU|END"), ("abusive", 0.6, "what|was|wat FOULP TRASH|WASTE"), ("abusive", 0.4, "YOU BE DET? FOULP? TRASH"),
    ("abusive", 0.25, "HE|KIN BE VERY* INS"), ("abusive", 0.25, "YOUR FOULP? KIN BE VERY* INS|VOC"), ("abusive", 0.25, "tu|dein|deine|jouw|el|la KIN BE VERY* INS|VOC"), ("abusive", 0.15, "BE INS who|der|die|que HURT|OUGHT"), ("abusive", 0.0, "HE|NAME BE INS"),
    ("abusive", 0.3, "YOU|YOUR _{0,9} VOC END"), ("abusive", 0.3, "VOC YOU|YOUR _{0,8} END"), ("abusive", 0.4, "cry|shut|stop|calla|callate|cierra|HUSH _{0,3} VOC"), ("abusive", 0.6, "calla|callate|callad ya? VOC"), ("abusive", 0.1, "OUGHT be|get HURT"), ("abusive", 0.4, "VOC|INS who|der|die|que OUGHT BEHURT"),
    ("abusive", 0.4, "OUGHT KILL INS|VOC"), ("abusive", 0.2, "OUGHT KILL INS|VOC in|on DET? LABODY|BODY"), ("abusive", 1.0, "shut|cierra|cierren YOUR FOULP? HUSH"), ("abusive", 1.1, "halt|haltet die|deine|dein|eure FOULP? HUSH|LABODY"), ("abusive", 1.1, "halt|haltet LABODY"), ("abusive", 1.1, "hou|houd je|jouw|jullie FOULP? HUSH|BODY"), ("abusive", 1.1, "hou|houd BODYP"),
    ("abusive", 0.3, "cierra|cerrad|tanca LABODY VOC"), ("abusive", 1.1, "fuck|screw YOU"), ("abusive", 1.0, "fuck|piss off"), ("abusive", 1.0, "verpiss|fick dich"), ("abusive", 1.1, "fuckyou|fucku|fuckoff"), ("abusive", 1.0, "kiss|lick my|mein|mi ass|arse|boots|arsch|culo"),
    ("abusive", 0.6, "FOULP face|mug|fresse|cara|smoel of|de|von|van"), ("abusive", 1.1, "YOU OUGHT be ashamed to|of LIVE|breathing|existing"), ("abusive", 0.6, "drop dead VOC? YOU?"), ("abusive", 1.0, "drop dead YOU|VOC"), ("abusive", 0.2, "VOC of DET year"),
    # threats
    ("abusive", 0.3, "ME MIGHT to|a? _{0,2} HARM"), ("abusive", 0.2, "si|wenn|if|als YOU _{0,6} HARM"), ("abusive", 0.3, "ME HARM"), ("abusive", 0.0, "HARM"), ("abusive", 0.3, "ME MIGHT set THINGP on fire"), ("abusive", 0.6, "MIGHT set THINGP on fire"), ("abusive", 1.0, "ME MIGHT make YOU pay|regret|bleed|suffer"),
    ("abusive", 0.6, "COME round|over|for|YOU? _{0,3} with|mit|con|met|amb DET|my? WEAPON"), ("abusive", 0.6, "ME COME with|mit|con|met|amb DET|my? WEAPON"), ("abusive", 1.1, "where|wo|waar|donde|on YOU|YOUR _{0,4} LIVE _{0,4} ME MIGHT? COME|KILL|HARM|hurt"), ("abusive", 0.5, "where YOUR THINGS|THINGP _{0,3} school _{0,3} ME MIGHT HURT|KILL"), ("abusive", 0.6, "ME MIGHT KILL THEY"),
    # wishes of harm
    ("abusive", 0.0, "HOPE YOU|YOUR _{0,3} DIE"), ("abusive", 0.3, "HOPE THINGP _{0,7} DIE"), ("abusive", 0.0, "HOPE que|i? _{0,3} DIE"), ("abusive", 0.2, "HOPE DIE YOU"), ("abusive", 0.3, "HOPE _{0,1} DIE YOU"), ("abusive", 0.3, "go|vete|geh|ga and|a|und|en? DIE in|under|at|yourself|already|alone|slowly"), ("abusive", 0.4, "DIE VOC"), ("abusive", 0.3, "VOC|INS DIE"), ("abusive", 0.3, "VOC|INS _{0,3} DIE in|t|te|en"),
    ("abusive", 1.2, "kill|hang|drown yourself|yourselves|urself"), ("abusive", 0.3, "DIE t|te|dich en|i|al|el|in"), ("abusive", 1.1, "nobody|noone|niemand|nadie|ningu would|wird|will|wurde|te|et|zou _{0,1} miss|vermissen|missen|echara|trobara YOU"), ("abusive", 1.0, "no loss if YOU"), ("abusive", 1.0, "world _{0,3} better _{0,2} without YOU"),
    ("abusive", 1.0, "do us|everyone _{0,2} favour|favor and do? NOT|DIE|disappear|kill"), ("abusive", 0.7, "YOULIKE OUGHT _{0,8} BEHURT|HURT|LEFT|DIE|EXPEL|EXPELTHEM"), ("abusive", 0.5, "YOULIKE _{0,2} DIE"), ("abusive", 0.4, "YOULIKE BE INS|VOC|FOULP"), ("abusive", 0.4, "nobody cares _{0,2} YOULIKE"),
    # groups degraded
    ("hateful", 0.2, "GROUP BE all|alle|todos|tots|just|only|nothing? VERM"), ("hateful", 0.2, "GROUP _{1,3} BE VERM"), ("hateful", 0.2, "GROUP BE all? CRIME"), ("hateful", 0.2, "GROUP BE CRIME and|y|und VERM"), ("hateful", 0.2, "THEY BE all? VERM"), ("hateful", 0.3, "GROUP BE all|alle|todos|tots? FOULP"), ("hateful", 0.2, "GROUP BE INS|VOC"), ("hateful", 0.2, "GROUP BE YOUR|ME|unser|nuestra|ons RUIN"), ("hateful", 0.3, "GROUP BE VERY* RUIN"),
    ("hateful", 0.2, "GROUP|THEY FOLK? BREED like|wie|como|als|com VERM"), ("hateful", 0.3, "GROUP BREED like|wie|como|als|com CRIME"), ("hateful", 0.8, "GROUP have|has|haben|hebben|tienen NOT business|place|right|rights on|in|here|among|with|to"), ("hateful", 0.8, "GROUP do|does|BE NOT belong|fit among|here|with|in|to"), ("hateful", 0.8, "GROUP dont|doesnt belong|fit among|here|with|in"), ("hateful", 1.0, "she|women|PEOPLE|GROUP OUGHT stay|be back? in|at the? kitchen"),
    # groups to be driven out, harmed or left to die
    ("hateful", 0.2, "GROUP OUGHT _{0,2} BEHURT|HURT|DIE|EXPELP"), ("hateful", 0.2, "GROUP OUGHT to? be thrown|kicked|sent|shipped OUT"), ("hateful", 0.1, "KILL all|every|DET? GROUP"), ("hateful", 0.2, "KILL all? of? GROUP"), ("hateful", 0.3, "EXPELP into|in|to|like? DET? VERM|sea|sjo?"), ("hateful", 0.3, "EXPELP"), ("hateful", 0.5, "EXPELP _{0,3} come|came|belong|Loch|hole|jungle|loch|mar|zee|meer|sea|land"),
    ("hateful", 0.3, "OUGHT que? EXPEL a|als|los|las? GROUP"), ("hateful", 0.3, "OUGHT que? EXPEL a|als? GROUP a patadas|cops"), ("hateful", 0.3, "OUGHT que? EXPELTHEM"), ("hateful", 0.5, "OUGHT que? EXPELTHEM a|per patadas|cops"), ("hateful", 0.7, "cal fer los fora"), ("hateful", 0.7, "cal|caldria fer|ferlos fora|GROUP"), ("hateful", 0.8, "EXPEL OUT GROUP"), ("hateful", 0.7, "EXPEL GROUP OUT"),
    ("hateful", 0.85, "RAUS mit|con|amb|with GROUP|ihnen|denen"), ("hateful", 0.85, "GROUP raus|fuera|fora END"), ("hateful", 0.85, "GROUP raus"), ("hateful", 0.85, "fora|fuera los|els|las|les? GROUP"), ("hateful", 0.8, "round up? GROUP up? _{0,3} EXPEL"), ("hateful", 0.7, "NOT HELP a|single|any? GROUP|one"), ("hateful", 0.5, "NOT HELP _{0,3} GROUP"), ("hateful", 0.8, "why|warum|por|waarom SPEND _{1,3} on|auf GROUP"),
    ("hateful", 0.3, "let|leave|lasst|dejad|laat GROUP _{0,1} DIE"), ("hateful", 0.9, "ME OUGHT|MIGHT? FIRE down? DET|their|our|THEY? HOSTEL"), ("hateful", 0.7, "GROUP _{0,6} ME FIRE DET HOSTEL"),
    # sexual offers and demands
    ("sexual", 0.3, "HOT SLUT _{0,5} WANT _{0,3} SEXVERB"), ("sexual", 0.3, "SLUT HOT _{0,5} WANT _{0,3} SEXVERB"), ("sexual", 0.1, "HOT|HORNY singles|SLUT _{0,5} WANT _{0,3} SEXVERB"), ("sexual", 0.4, "HOT SLUT _{0,4} MEDIA|tonight|online|waiting"), ("sexual", 0.4, "HORNY SLUT"),
    ("sexual", 0.4, "ME BE|am|m VERY* HORNY"), ("sexual", 0.5, "ME BE|am|m VERY* HORNY"), ("sexual", 0.2, "ACT _{0,3} ME|YOUR|MEDIA NUDE"), ("sexual", 0.4, "ACT ME? NUDE"), ("sexual", 0.3, "ME|YOUR NUDE"), ("sexual", 0.3, "ACT _{0,2} NUDE von|of|from? YOU"),
    ("sexual", 0.8, "ACT _{0,3} MEDIA _{0,2} without|ohne|zonder|sin|sense YOUR|any? clothes|ropa|roba|kleidung|kleren"), ("sexual", 0.3, "ACT _{0,3} BARE MEDIA"), ("sexual", 0.3, "ACT _{0,3} MEDIA BARE|NUDE"), ("sexual", 0.7, "SEXP _{0,2} in|on ME? mouth|face|bed|hands"), ("sexual", 0.3, "SEXVERB SEXP"), ("sexual", 0.3, "SEXVERB LABODY"), ("sexual", 0.5, "ACT ME? SEXP"),
    ("sexual", 0.5, "WANT to|ME|DET|YOU? SEXVERB YOU|ME"), ("sexual", 0.5, "WANT YOU|YOUR|deine|je|amb _{0,3} SEXVERB"), ("sexual", 0.5, "WANT SEXVERB amb|con|with|mit YOU"), ("sexual", 0.5, "SEXVERB YOU _{0,3} bed|hard|all|tonight|night|now|mouth|raw"), ("sexual", 0.5, "SEXP WANT SEXVERB"), ("sexual", 0.6, "YOUR SEXP lecken|likken|lutschen|llepar"), ("sexual", 0.3, "SEXP SEXVERB"),
    ("sexual", 0.5, "watch|free|uncensored|uncut|best|live|hardcore _{0,2} PORN"), ("sexual", 0.3, "wet|hard SEXPART|SEXP and? wet|hard? SEXPART|SEXP"), ("sexual", 0.3, "SEXP and SEXP"), ("sexual", 0.2, "PORN _{0,3} MEDIA"), ("sexual", 0.3, "MEDIA|hot|free|HOT _{0,2} PORN"), ("sexual", 0.3, "PORN MEDIA of|de|mit|met _{0,1} SEXP"), ("sexual", 1.0, "blow job|jobs"), ("sexual", 1.1, "sit on ME face"), ("sexual", 1.1, "sit on BODYP|LABODY"),
]
