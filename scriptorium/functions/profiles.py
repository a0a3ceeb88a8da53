"""What a language decides: words, sentence guards, greetings, closings, tics, masks.

Lists are kept as sorted strings of words. A language without a profile gets the English
machinery with everything that English itself decides taken out.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

COLLECT_MASKS = ("[address]", "[amount]", "[email]", "[iban]", "[phone]", "[reference]")


def _w(text: str) -> tuple[str, ...]:
    return tuple(sorted(set(text.split())))


@dataclass(frozen=True)
class Tic:
    name: str
    kind: str  # starts, interjection, connective, one_word, character, quotation, pattern, shout
    arg: str = ""


@dataclass(frozen=True)
class Profile:
    lang: str
    word: str
    abbreviations: tuple[str, ...]
    openers: tuple[str, ...]
    closing: tuple[str, ...]
    always: tuple[str, ...]
    interjections: tuple[str, ...]
    connectives: tuple[str, ...]
    masks: dict = field(hash=False)
    families: tuple[tuple[str, str], ...] = ()
    familiar: tuple[str, ...] = ()
    formal: tuple[str, ...] = ()
    tics: tuple[Tic, ...] = ()
    bigrams: dict = field(default_factory=dict, hash=False)
    trigrams: dict = field(default_factory=dict, hash=False)

    @property
    def second_person(self) -> bool:
        return bool(self.familiar or self.formal)

    def kept(self) -> frozenset[str]:
        return frozenset(self.openers + self.closing + self.interjections + self.always)

    def placeholders(self) -> tuple[str, ...]:
        return tuple(sorted({*self.masks.values(), *COLLECT_MASKS}))


def _rates(text: str) -> dict[str, int]:
    """'12 a b, c d; 3 e f' as {'a b': 12, 'c d': 12, 'e f': 3}."""
    found = {}
    for group in text.split(";"):
        number, _, names = group.strip().partition(" ")
        for name in names.split(","):
            found[name.strip()] = int(number)
    return found


_CORE = r"\p{L}[\p{L}\p{N}]*(?:-[\p{L}\p{N}]+)*"

FRENCH = Profile(
    lang="fr",
    word=rf"{_CORE}'?",
    abbreviations=_w("art av bd cf dr env etc ex m mlle mm mme mmes n no p st ste"),
    openers=_w("bonjour bonsoir cher chere cheres chers coucou ma madame maitre mes mesdames messieurs mon monsieur salut"),
    closing=_w(
        "a adieu affectueusement agreer amicalement amities beaucoup bien bientot bises bisous bonne bonnes chaleureusement "
        "consideration continuation cordiales cordialement de demain des distinguees distingues du embrasse encore et expression "
        "fort je journee la le les meilleures merci plus prie respectueusement salutations sentiments sinceres soiree tard te "
        "tendresses toi tout vous weekend"
    ),
    always=_w(
        "a ai ainsi alors annee aout apres as assez au aucun aucune aura aurai aurons auront aussi autant autre autres aux avaient "
        "avais avait avant avec avez avions avons avril bien ca car ce ceci cela celle celles celui cependant certaines certains ces "
        "cet cette ceux chacun chacune chaque chez comme contre dans de decembre deja demain depuis des dimanche donc dont du durant "
        "elle elles en encore enfin ensuite entre envers es est et etaient etais etait ete etes etions eu eux faut fevrier hier hors "
        "il ils jamais janvier je jeudi jour juillet juin jusque la laquelle le lequel les leur leurs lorsque lui lundi ma mai mais "
        "malgre mardi mars matin me meme memes mercredi mes moi moins mois mon neanmoins ni nos notre nous novembre nuit octobre on "
        "ont or ou outre par parmi pendant personne peu peut plus plusieurs plutot pour pourtant puis puisque quand que quel quelle "
        "quelles quels qui quoi quoique rien sa samedi sans se selon semaine septembre sera serai serons seront ses si sinon soi soient "
        "soir soit sommes son sont sous souvent suis sur surtout ta tant te tes toi ton toujours tous tout toute toutefois toutes tres "
        "trop tu un une vendredi vers voici voila vos votre vous y"
    ),
    interjections=_w("ah allez bien bon bref donc eh enfin oh tiens voila"),
    connectives=_w("car donc et mais or"),
    masks={"name": "[nom]", "email": "[email]", "phone": "[telephone]", "number": "[numero]", "url": "[url]", "iban": "[iban]"},
    families=(
        ("a bientot", r"@(?:à|a)\s+bient[oô]t@"),
        ("a toi / a vous", r"@(?:tout\s+)?(?:à|a)\s+(?:vous|toi)@"),
        ("adieu", r"@adieu@"),
        ("amicalement", r"@amicalement@"),
        ("amities / tendresses", r"@(?:affectueusement|tendresses?|amiti[eé]s)@"),
        ("bien a vous / bien a toi", r"@bien\s+(?:à|a)\s+(?:toi|vous)@"),
        ("bises / bisous", r"@bis(?:ous|es|e)@"),
        ("cordialement", r"@cordialement@"),
        ("je t'embrasse / je vous embrasse", r"@embrasse@"),
        ("merci", r"@merci@"),
        ("salutations / agreer", r"@(?:consid[eé]ration|agr[eé]{2}r|salutations)@"),
    ),
    familiar=_w("t' ta te tes tien tienne tiennes tiens toi ton tu"),
    formal=_w("vos votre votres vous"),
    tics=(
        Tic("citation entre guillemets", "quotation"),
        Tic("et ou mais en tete de phrase", "connective"),
        Tic("exclamation doublee", "pattern", r"!\s*!"),
        Tic("incise entre tirets", "pattern", r"\S\s-\s\S"),
        Tic("interjection en tete", "interjection"),
        Tic("je en tete de phrase", "starts", "je j'"),
        Tic("mot en capitales", "shout"),
        Tic("parenthese", "character", "("),
        Tic("phrase d'un seul mot", "one_word"),
        Tic("point-virgule", "character", ";"),
    ),
    bigrams=_rates(
        "70 de la; 45 c'est; 40 de l'; 30 j'ai, à la; 28 y a, il y; 26 ne pas; 25 d'un, je ne; 22 que je; 20 ce que, d'une, il est, je vous; "
        "18 ce qui, et de, je suis, n'est; 15 dans la, dans le; 14 que la, que le; 12 de ce, et je, il faut, je te, plus de, pour la, pour le, sur la, sur le; "
        "10 a été, est un; 9 est une; 8 de mon, de votre, de vous, parce que, tout le, vous avez; 7 de ma, de me, vous êtes; 6 à vous; 5 a bien; 4 au moins, bien que, en train"
    ),
    trigrams=_rates(
        "26 il y a; 14 n'est pas; 6 c'est un; 5 c'est une, ce que je, il n'y, je n'ai; 4 il faut que, y a pas; 3 ce qui est, de plus en, plus en plus; "
        "2 dans le monde, de la vie, je vous prie, tout de même, à la fois"
    ),
)

ENGLISH = Profile(
    lang="en",
    word=r"\p{L}[\p{L}\p{N}]*(?:['-][\p{L}\p{N}]+)*",
    abbreviations=_w("approx dr eg etc fig ie inc ltd mr mrs ms no prof st vs"),
    openers=_w("afternoon dear good greetings hello hey hi morning"),
    closing=_w(
        "a again all and best care cheers day ever faithfully for good have in kind know later let me much regards see sincerely soon "
        "speak take talk thank thanks the to touch very warm week weekend wishes you yours"
    ),
    always=_w(
        "a about across after against all also although always am among an and another any anyone april are as at august be because "
        "been before behind being between beyond both but by can could december did do does during each even evening every everyone few "
        "for february friday from had has have he her here him his however i i'd i'll i'm i've if in into is it its january july june "
        "just let many march may maybe me meanwhile might monday month more morning most much must my never night no nobody nor november "
        "october often on one only or other otherwise our over perhaps saturday september shall she should since so some someone still "
        "such sunday than that the their them then there therefore these they this those though through thursday to today tomorrow "
        "tuesday under unless until us was we wednesday week were what when where whether which while who whom whose will with within "
        "without would year yesterday yet you your"
    ),
    interjections=_w("ah anyway honestly look oh ok okay right so well"),
    connectives=_w("and but or so yet"),
    masks={"name": "[name]", "email": "[email]", "phone": "[phone]", "number": "[number]", "url": "[url]", "iban": "[iban]"},
    families=(
        ("best / all the best", r"@best@"),
        ("cheers", r"@cheers@"),
        ("let me know", r"@let me know@"),
        ("regards", r"@regards@"),
        ("sincerely / yours", r"@(?:faithfully|yours|sincerely)@"),
        ("talk soon / see you", r"@(?:see|speak|talk)\s+(?:to\s+)?(?:you\s+)?(?:later|soon)@"),
        ("thanks / thank you", r"@(?:thank you|thanks?)@"),
    ),
    tics=(
        Tic("I at the start of a sentence", "starts", "i"),
        Tic("and or but at the start of a sentence", "connective"),
        Tic("contraction", "pattern", r"(?iu)\p{L}'(?:ll|re|ve|d|m|s|t)@"),
        Tic("dash aside", "pattern", r"\S\s-\s\S"),
        Tic("doubled exclamation", "pattern", r"!\s*!"),
        Tic("interjection at the start", "interjection"),
        Tic("one word sentence", "one_word"),
        Tic("parenthesis", "character", "("),
        Tic("quotation", "quotation"),
        Tic("semicolon", "character", ";"),
        Tic("shouted word", "shout"),
    ),
    bigrams=_rates(
        "80 of the; 70 in the; 50 to the; 32 on the; 30 and the, for the; 28 at the; 26 to be; 25 with the; 20 from the, it is, it's, that the; "
        "15 i am, i have, this is; 12 don't, will be; 10 i will, if you, one of, there is, we are, would be; 9 i would, we have; "
        "8 as well, going to, has been, i think, i'm, that's, you can; 6 more than, some of, thank you; 5 let me; 4 a lot, in order; 3 make sure"
    ),
    trigrams=_rates(
        "10 one of the; 6 as well as; 5 a lot of; 4 in order to, it would be, there is a; "
        "3 at the same, be able to, i have been, i think that, i would like, let me know, thank you for, the fact that, the same time"
    ),
)


def profile_for(lang: str | None) -> Profile:
    known = {"fr": FRENCH, "en": ENGLISH}
    if lang in known:
        return known[lang]
    return replace(ENGLISH, lang=lang or "", families=(), closing=(), always=(), bigrams={}, trigrams={}, tics=tuple(t for t in ENGLISH.tics if t.name != "contraction"))


#: Function words that tell one language of the profiles from another.
FUNCTION_WORDS = {
    "en": _w("and are be for have in is it my not of that the this to we will with you your"),
    "fr": _w("au avec ce dans des du est et je la le les nous pas pour que qui sur une vous"),
}
