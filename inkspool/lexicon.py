"""Word and trigram tables of the language features, as data."""

from __future__ import annotations

#: Frequent English words; contractions are listed without their apostrophe.
COMMON = frozenset(
    """
government understand different important consider continue remember shouldnt because believe
between company couldnt include perhaps problem require suggest through wouldnt always appear become
before cannot change create doesnt during expect follow happen havent having little number person
please public really remain report should thanks theres theyll theyre theyve werent wheres about
above after again allow arent begin being below bring build child could didnt doing early every
first great group hadnt hasnt large learn leave maybe might never offer other place point raise
reach right serve shall shell small sorry speak spend stand start still thats their there these
thing think those under until wasnt watch whats whens where which while woman world would write
youll young youre youve able also away back been call cant case come does dont down each even fact
fall feel find fine from give good grow hand have hear hell help here high hold hows into isnt just
keep kill know last lead life like live long look lose love make mean meet more move much must need
next nope okay only open over part pass play read same seem sell send shes show some stay stop sure
take talk tell than that them then they this time turn very wait walk want week well were weve what
when whoa whos will with wont work yeah year your add all and any are bad big but buy can cut day
did die eye few for get had has her hes hey him his hmm how huh ill its ive let man may nah new not
now off old ooh our out own pay put run see set she sit the too try ugh use was way who why win wow
yay yep yes you ah am an as at be by do go he if im in is it me my no of oh ok on or ow so to uh um
up us we a i
""".split()
)

#: Words of comics: colloquial forms, sounds, emotions.
COMIC = frozenset(
    """
chuckle whisper giggle scream splash whoosh cause click crack crash dunno frown gonna gotta kinda
laugh lemme shout smile smirk sorta thump wanna bang beep boom cmon gasp grin sigh slam snap thud
weep yall yell zoom bam cos cry cuz pow sob
""".split()
)

DICTIONARY = COMMON | COMIC


def _scores(table: str) -> dict[str, float]:
    out = {}
    for line in table.strip().splitlines():
        score, *words = line.split()
        out.update(dict.fromkeys(words, float(score)))
    return out


#: Each line: a score, then the words that have it.
WORD_SCORES = _scores(
    """
1.4 nope hmm nah yep
1.5 huh um
1.6 uh
1.7 wow
1.8 thanks ah
1.9 first sorry even help sure well work our way
2.0 please after also back okay stop how two use ok
2.1 think come look only over wait yeah its
2.2 other than them then now see yes
2.3 could good into some year your hey
2.4 people just know take him no
2.5 like make time when can oh
2.6 which go me
2.7 about get who if
2.8 out so up
2.9 their there what
3.0 would all one
3.1 will an my
3.2 her she or
3.3 say we
3.4 from they
3.5 his by
3.6 this but
3.7 at do
3.8 you as he
3.9 with on
4.0 for not
4.1 it
4.2 have i
4.3 that
4.4 in
4.5 and a
4.6 of
4.7 to
4.8 be
5.0 the
"""
)
UNKNOWN_WORD = 0.5

#: Each line: a score, then the trigrams that have it.
TRIGRAM_SCORES = _scores(
    """
2.3 ldn
2.4 ont
2.5 ain don kno nde use
2.6 abo ell eve hin oul our
2.7 com ect ght ill now ous rea was
2.8 can ess ive not one
2.9 are pro thi wha wit
3.0 ers ith men ted
3.1 nce ons
3.2 all out ver
3.3 con res
3.4 ate his
3.5 ere you
3.6 hat ter tha
3.7 her
3.8 ent for
3.9 tio
4.0 ion
4.2 and
4.3 ing
4.5 the
"""
)
UNKNOWN_TRIGRAM = 0.3

#: Whole utterances that count as dialogue on their own.
SHORT_DIALOGUE = frozenset(
    "ah fine help hey how no nope oh ok okay please sorry stop sure thanks wait what when where who why wow yeah yep yes nah".split()
)

#: A text that contains one of these reads as a control of a user interface.
UI_WORDS = tuple("back cancel follow followers login logout next profile search settings submit user".split())
WARNING_WORDS = ("content warning", "disclaimer", "episode contains", "may be unsuitable", "trigger warning", "viewer discretion", "warning")
