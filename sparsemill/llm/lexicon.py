"""Words of offensive language in English, German and French, by what they do in a sentence. The lists are fixed values.

They are general vocabulary: insults, violent acts, parts of the body and so on as a dictionary gives them, not phrases. ``moderation`` says
which classes have to come together. A word may be in several classes.
"""

from __future__ import annotations


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Nouns that are insults whenever they are said of a person.
INSULTS = _words("""
arse arsehole asshole bastard bitch blackguard blockhead brute buffoon charlatan coward cretin crook cunt degenerate dimwit dolt dullard
dunce fool fraud good-for-nothing guttersnipe hag halfwit harlot hussy hypocrite idiot imbecile jackass knave layabout liar lout lowlife
moron nincompoop nitwit numskull oaf parasite rascal reprobate rogue ruffian scamp scoundrel scum shyster simpleton slattern slut sneak
strumpet swindler thief trollop twit vagabond villain wastrel weakling whore wretch
arschloch bengel betrüger blödmann bösewicht depp drecksack drecksau drecksack dummkopf dreckskerl feigling flegel gauner halunke hure hurensohn
idiot kanaille lügner lümmel lump lumpenhund miststück nichtsnutz nutte saukerl schlampe schuft schurke schweinehund spitzbube strolch
taugenichts tölpel trottel trottel versager wicht
abruti bâtard canaille charogne connard connasse coquin crapule crétin escroc fainéant fripouille fumier garce goujat gredin imbécile
lâche maraud menteur minable ordure pourriture putain pute salaud saligaud salope scélérat traîne-savates vaurien voyou
""")

#: Names of contempt for peoples and for whom people love; alone no other sense.
SLURS = _words("""
dago dagos darkies faggot faggots golliwog gook gooks kike kikes nigger niggers raghead ragheads spics wop wops wogs kanake kanaken judensau
nigger schwuchtel schwuchteln zigeunerpack bicot bicots bougnoule bougnoules nègres pédale pédés youpin youpins
""")

#: Animals and things that are insults only when they are said to a face or with a word of contempt.
FIGURES = _words("""
ass cur dog dogs donkey dung dunghill filth hog louse maggot mongrel pig pigs rat sow swine toad vermin viper weasel worm
esel hund köter ratte sau schwein ungeziefer wurm
âne chien cloporte cochon crapaud porc rat vermine vipère
""")

#: Words of contempt for persons, which other things are seldom called.
CONTEMPT = _words("""
bloody brainless bumbling cheating conniving contemptible cowardly crawling craven damned despicable drunken fat filthy foul godforsaken
goddamned gutless half-witted idiotic loathsome lousy lying mangy miserable pathetic pox pitiful putrid ridden rotten scheming shameless sleazy slimy
snivelling spineless stinking stupid thieving two-faced faced ugly useless vile whining witless worthless wretched
dreckig dreckige dreckiger dreckiges dumm dumme dummer dummes elend elende elender elendes ekelhafter faul fauler feige feiger fett fetter
gemeiner lausiger mieser nichtswürdiger stinkend stinkende stinkender stinkendes verdammt verdammte verdammter verdammtes verflucht verfluchte
verfluchter verfluchtes verkommener verlogener versoffener widerlicher
fichu fichue foutu foutue ignoble immonde infâme maudit maudite misérable pauvre puant puante pourri pourrie répugnant sacré sale stupide
vil dégoûtant
disgusting dirty
""")

#: What is done to a person in a threat, with something of theirs as its object.
VIOLENCE = _words("""
bash bashed beat beaten break broken burn burned burnt carve chop crack crush cut flay gouge kick knock mash pound punch rip rip skin slash slit smash snap
split squash stave tear thrash throttle trample twist wring
breche brechen einschlagen haue poliere polieren reiße schlage schlagen schlitze schneide schneiden stopfe trete zerschlage zerschlagen zertrete
arrache arracherai brise briser briserai casse casser casserai coupe couper couperai crève crèverai défonce défoncer écrase écraser écraserai
fracasse fracasser massacre tords tordrai tranche trancher trancherai
""")

#: What it is done to.
TARGETS = _words("""
arms back belly bones brains ears eyes face fingers guts head hide house jaw knees legs liver neck nose ribs roof skull snout spine teeth
throat windows windpipe
fresse genick hals kehle knochen kopf maul nase rippen rückgrat schädel schnauze zähne
bras cou crâne dents figure gorge gueule jambes nez os tête tripes yeux
""")

#: Killing and beating whose object is the person.
KILLING = _words("""
butcher choke drown exterminate flog flogged gut hang hanged horsewhip horsewhipped kill lynch lynched murder poison shoot skin slaughter stab strangle swing
thrash thrashed throttle whip whipped
abstechen aufhängen aufschlitzen erdrosseln erschießen erschlage erschlagen ersäufe erwürge erwürgen kaltmachen prügeln töten totschlage
totschlagen tötet erschießt erschlagt hängt umbringe umbringen verprügeln
assommer crever égorge égorger égorgerai étrangle étrangler étranglerai fouetter pendez pendre tuer tuerai tuez
""")

#: Wishes of harm, said to a person.
CURSES = _words("""
burn choke croak damn damned die drown hell perish rot shame starve suffocate
ersticke krepiere stirb teufel verfaule verrecke verrecken
crève crever enfer étouffe meurs pourris
""")

#: Bidding someone silent.
SILENCE = _words("halt halte halts hold shut stop ferme fermez tais taisez")
MOUTH = _words("face gob jaw mouth tongue trap fresse klappe maul rand schnauze bec bouche gueule toi")

#: What a people is called to deny that they are human.
DEHUMANIZING = _words("""
abomination animals apes baboons beasts blight brutes cancer cholera cockroaches contagion curse degenerates dirt disease dogs dregs filth
fungus gangrene garbage germs infestation insects leeches leprosy lice locusts maggots mildew mongrels monkeys mould parasites pest pestilence pigs plague rabble rats refuse
reptiles riff-raff rubbish savages scourge scum smallpox snakes spiders subhuman subhumans swarm swine trash tumour typhus vermin vipers weeds
abschaum affen aussatz bestien brut gesindel gezücht gewürm hunde insekten köter krankheit krebsgeschwür kakerlaken läuse maden pack parasiten pest
pestbeule plage ratten schädlinge schlangen schmarotzer schweine seuche tiere untermenschen ungeziefer unrat vieh wanzen zecken
animaux bétail bêtes cafards cancer choléra chiens cochons déchets fléau insectes lèpre nuisibles parasites peste porcs poux punaises racaille rats
sangsues sauvages serpents singes sous-hommes vermine vipères
""")

#: Of these, those that are hardly ever said of anything but people after "these" or "this".
CONTEMPTUOUS = _words("""
degenerates dregs rabble riff-raff savages scum subhumans abschaum brut gesindel gezücht pack schmarotzer untermenschen ungeziefer racaille
sous-hommes vermine parasites sangsues
""")

#: What is demanded to be done to a people.
HARM = _words("""
annihilated banished bullet bullets butchered castrated deported enslaved eradicated exterminated flogged gallows gassed gibbet hanged
horsewhipped hounded lashed liquidated lynched massacred noose purged rope scourged slaughtered starved sterilised sterilized stoned whipped
aufgehängt aufhängen ausgemerzt ausgerottet ausrotten davongejagt davonjagen entmannt erhängt ersäufen ersäuft erschießen erschossen
fortgejagt fortjagen galgen gepeitscht gesteinigt peitsche totgeschlagen totschlagen verbrannt verbrennen vergast verjagen verjagt
vernichten vernichtet vertilgen vertilgt
anéantir chassés corde éradiquer exterminer exterminés fouet fouetter fusiller massacrer noyer pendre pendus potence
""")

#: What may be demanded of other things too.
REMOVAL = _words("""
beaten burned burnt caged chained culled destroyed driven drowned erased expelled forbidden hunted imprisoned jailed killed locked shipped shot
swept transported wiped
ausgewiesen eingesperrt einsperren ersticken hinausgeworfen verbannt vertreiben vertrieben strick zuchthaus
bannir brûler chasse chasser éliminer enfermer exiler expulser expulsés supprimer
""")

#: What ranks a people below others.
INFERIOR = _words("""
backward base degenerate inferior lesser low lower lowest mongrel primitive servile worthless entartet entartete minderwertig minderwertige niedere
niedrige abâtardie dégénérée immonde inférieure inférieures maudite sale
""")
RACE = _words("blood breed breeds caste order orders race races stock tribe brut rasse rassen sippe stamm volk engeance peuplade peuple race races sang")

#: What a person is called who counts for nothing.
NOTHING = _words("disgrace nobody nothing abschaum dreck nichts niemand schande honte moins rien déchet")

#: A right to live that is denied.
LIVING = _words("born breathe breed exist live life leben geboren leben existieren vivre vie naître nés respirer")
WORTH = _words("deserve deserves fit ought right should worthy unworthy recht verdienen wert würdig digne dignes droit mérite méritent")
NEVER = _words("neither never no not nobody nor kein keine keinen keinerlei nicht nie niemals jamais ne ni pas")

#: Parts of the body that are named for lust.
BODY = _words("""
bosom bosoms breasts buttocks crotch genitals groin haunches hips loins nipple nipples penis rump thighs tits vagina vulva
brüste brüsten brustwarze brustwarzen busen glied hinterbacken hintern hüften lenden schamlippen schenkel schenkeln schenkeln schoß
cuisses croupe fesses hanches mamelons poitrine reins seins sexe tétons verge
""")

#: What is done with them.
ACTS = _words("""
bit caressed caressing caress cupped fingered fondled fondling fondle groped groping kissed kneaded licked licking mounted nibbled penetrated
pinched pressed probed ravished rubbed sodomised squeezed straddled stroked stroking sucked sucking thrust thrusting undressed
begrapschte befummelte drang entkleidete küsste küßte knetete leckte liebkoste rieb presste preßte saugte stieß streichelte
caressa caressait embrassa empoigna lécha léchait malaxait palpait pelotait pénétra pénétrait pétrissait pressa suça suçait tripotait déshabilla
""")

#: Skin and flesh, which only bareness and an act together make a matter of lust.
FLESH = _words("bodies body flesh lips mouth shoulders skin fleisch haut körper leib lippen mund chair corps lèvres peau")

#: Signs of lust.
AROUSAL = _words("""
aroused arousal climax climaxed climaxing ecstasy erect erection groaned lust lustful moaned moaning orgasm panted panting rapture wanton writhed
writhing
erregt erregung geil höhepunkt keuchte lust stöhnte stöhnend wollust wollüstig
excitation extase frémissait gémissait gémit gémissant haletait haletant jouissance jouit luxure orgasme plaisir volupté
""")

#: Bareness, which beside a part of the body shows it.
NAKED = _words("bare bared naked nude unclothed uncovered entblößt entblößte nackt nackte nackten dénudé dénudée nu nue nues nus")

#: Spreading the legs.
SPREAD = _words("apart opened parted spread gespreizt öffnete spreizte écarta écartait écartées ouvrit")
LEGS = _words("knees legs thighs beine schenkel cuisses genoux jambes")
BED = _words("bed couch mattress sheets sofa bett laken lit draps")
SPENT = _words("exhausted spent sweating wet naked nass nackt verschwitzt mouillés nus épuisés")

#: Words that are explicit alone.
EXPLICIT = _words("""
blowjob buggery cunnilingus ejaculated fellatio fornicating fuck fucked fucker fucking masturbated masturbating masturbation
ejakulierte ficken fickte fotze gefickt masturbierte wichsen wichste
branler branlait éjacula enculer foutre fellation masturbait
""")

#: Words of animals, goods, plants, weather, sickness and trade, near which single words mean what they say.
PLAIN = _words("""
acre acres apples barley beans beef bottle bullocks butter calves cheese corn cow cows crop crops cwt dairy disinfectant ewes farm farmers
fields flock flour fruit garden grain granaries granary hay heifers hens herd hops horses infest infested kennel kennels lamb lambs lb manure
market meat milk mutton oats orchard orchards oxen pasture pen penned pens pigeons poultry poisoned potatoes powder prize seed seeds sheep soap
sows soil steers stock stoats tons traps tree trees turnips veterinary warehouse wash weeds wheat wool
acker dung ernte felder getreide heu kälber kartoffeln korn kühe lämmer mäuse milch obst pflanzen schafe speicher stall vieh weizen zentner
agneaux avoine blé bœufs champs étable foin fourrage grains granges lait moutons récolte semences troupeau vaches verger vignes
""")

#: Ordinary words of six letters or more that are one or two letters from an entry, or read like one.
ORDINARY = _words("""
abused backed battle better breast breath bullion bulletin button buttons bushel chaser chased chasse church cattle charge choking cooked coward crushed
cruise curses damage deliver denied departed deport exported exterior failed filthy foot fossil fosses garage hailed hanger hunger imported landed
licences listen lockets looked lowest marked medals messes misses moment morning mother mourning muscle mustard painted parade parasol
parties past pastor patrol people picked planted plaque plates played post posted potent pounds praised printed prison pulled railed ravine reached reported
rescue respect rotten sailed savings scanned scored selection election direction shipped shopped slight sluice snatch spread squeeze stated
stables stored stroke strict stretch swings tables threat threats throne throats thirst thirsts tights treats trusted verger vessels violin
wanted washed wheels whistle wicket willow window winner wished worker worship wretch writhe
beraten berichtet brüstung büsten errichtet halle hütten läufe leute lüften mauern nackten schenken schenkte verein vereine verrichtet fesse tresses
""")
