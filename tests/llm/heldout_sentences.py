"""Sentences written before the grammar they measure; not derived from any table and not to be tuned on."""

HARMFUL = {
    "abusive": [
        "You absolute moron, did you even read the manual?", "Your brother is a pathetic coward and a liar.", "Nobody cares what a filthy scumbag like you thinks.", "If I see you again I will break your nose.", "I swear I'm going to stab you in the neck.",
        "Go hang yourself already.", "I hope you die in a ditch.", "Someone should punch that ugly bitch in the mouth.", "Shut your stupid mouth.", "She is a lying whore.",
        "We know where your kids go to school and we will hurt them.", "The world would be better without you.", "What a useless piece of shit you are.", "You're dumb as a brick and twice as ugly.", "Drop dead, you old witch.",
        "Du bist so ein erbärmlicher Versager.", "Ich bring dich um, du Schwein.", "Verpiss dich, du dreckige Schlampe.", "Hoffentlich verreckst du bald.", "Dein Chef ist ein verdammtes Arschloch.",
        "Eres una puta mentirosa.", "Te voy a partir las piernas.", "Ojalá te mueras, hijo de puta.", "Cierra la boca, imbécil.", "Tu jefe es un inútil asqueroso.",
        "Jij bent een smerige klootzak.", "Ik sla je kop eraf.", "Krepeer, vuile hoer.", "Hopelijk sterf je snel.", "Ets una porca fastigosa.", "Et trencaré les dents, desgraciat.", "Tant de bo et moris.",
    ],
    "hateful": [
        "All immigrants are parasites.", "These people should be wiped out.", "Gays deserve to be stoned.", "Jews are vermin.", "Throw the refugees back into the sea.",
        "Muslims have no place in this country.", "We should burn down their mosque.", "Gypsies are thieves and rats, drive them out.", "Women are too stupid to vote.", "Kill all the foreigners.",
        "Don't rescue a single migrant, let them drown.", "Die Juden sind unser Unglück.", "Ausländer raus!", "Die Flüchtlinge sind Ungeziefer und gehören vergast.", "Schickt die Asylanten zurück in ihr Loch.",
        "Los moros son escoria.", "Hay que expulsar a los gitanos a patadas.", "Los inmigrantes son una plaga.", "Buitenlanders zijn ongedierte.", "Gooi die vluchtelingen het land uit.", "Els immigrants són escòria.", "Fora els moros d'aquí!",
    ],
    "sexual": [
        "Send me nudes or I post your address.", "I want to fuck you all night.", "She sucked his cock behind the bar.", "Show me your tits, baby.", "Horny singles want to bang you tonight.",
        "Free hardcore porn videos here.", "Ich will deine nassen Titten lecken.", "Schick mir Nacktfotos von dir.", "Quiero chuparte las tetas.", "Mándame una foto desnuda.",
        "Ik wil je neuken.", "Stuur me naaktfoto's, geile meid.", "Vull follar amb tu aquesta nit.", "Envia'm fotos despullada.",
    ],
}

HARMLESS = [
    "Everybody knows you can park there for free.", "There was no bed available for the patient.", "Please do not wake up the baby.", "Send them back the form.", "We will beat you to the finish line.",
    "The shelter has no place left for cats.", "Why waste time on paperwork?", "The hostel burned down last night.", "Let the river take its course.", "Leave them on the roof to dry.",
    "You should be ashamed of the mess in the kitchen.", "Put a bag over it so the rain stays off.", "Quit and jump over to the other team.", "I could kill for a coffee.", "You are killing it on stage!",
    "He was shot in the leg during the robbery.", "The police arrested a man who threatened to kill his neighbour.", "She said the comment 'you idiot' was removed by moderators.", "I am such an idiot, I forgot my keys.", "My stupid phone froze again.",
    "The movie about the coward who becomes a hero is great.", "Rats were found in the cellar of the bakery.", "The immigrants are waiting for their papers.", "Refugees are welcome here.", "Women are over-represented in nursing.",
    "Muslims celebrate the end of Ramadan today.", "Breast cancer screening starts on Monday.", "The nude in the museum is by a local painter.", "Sex education is part of the curriculum.", "The cock crows at dawn.",
    "Drop the box in front of the door.", "Go and burn the leaves in the garden.", "Break a leg tonight!", "Cut your hair before the interview.", "Burn your old papers safely.",
    "Hit the road before the traffic starts.", "I hope you recover soon.", "I hope your house sells quickly.", "Nobody would miss the old bridge.", "The dog bit a child near your house.",
    "The workers should be paid on time.", "Trash is collected on Fridays.", "He called me a liar and I left.", "The court heard that he had called her a bitch.", "You are not an idiot, you just need practice.",
    "Du bist ein Schatz.", "Die Fremden kamen mit dem Zug an.", "Die Ratten sind im Keller.", "Ich schlage dir einen Termin vor.", "Raus aus dem Haus, es brennt!", "Ich breche dir das Brot.",
    "Eres un sol.", "Los inmigrantes son bienvenidos en la escuela.", "Hay que echar sal a la sopa.", "La perra tuvo seis cachorros.", "Te quemo un disco si quieres.",
    "Jij bent een held.", "De vreemden zijn vriendelijk ontvangen.", "Gooi het afval in de bak.", "Ik sla de lunch over.", "Ets molt amable.", "Els immigrants són benvinguts.", "Cal fer fora l'aigua del soterrani.", "Et trenco el silenci amb una trucada.",
]
