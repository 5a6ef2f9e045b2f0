"""Fixed values of the content scorer: word lists and cue patterns, in English, Bangla and romanised Bangla."""

# Words that insult whoever they are said of or to.
INSULTS = (
    "idiot", "moron", "bastard", "bitch", "shithead", "asshole", "arsehole", "dumbass", "jackass", "cretin", "imbecile", "scumbag", "scum", "motherfucker",
    "dickhead", "prick", "cunt", "twat", "wanker", "whore", "slut", "dimwit", "halfwit", "nitwit", "retard", "creep", "jerk", "scoundrel", "pervert", "weirdo", "psycho", "buffoon", "simpleton", "blockhead", "airhead", "dunce", "douchebag", "lowlife", "dipshit", "numbskull", "haramjada", "kutta", "shala",
)
# Words that insult only when said of a person: animals, plain nouns.
WEAK_INSULTS = ("pig", "rat", "dog", "parasite", "cockroach", "fool", "clown", "worm", "swine", "loser", "donkey", "monkey", "snake", "leech", "coward", "filth", "trash", "garbage", "liar", "thief", "crook", "maggot", "vermin", "animal", "cow")
SCORN = ("stupid", "filthy", "pathetic", "worthless", "miserable", "dumb", "brainless", "useless", "gutless", "rotten", "goddamn", "spineless", "lying", "disgusting", "ugly", "dirty", "bloody", "fucking", "damn", "lousy", "shameless", "cowardly")
SEXUAL_WORDS = ("blowjob", "handjob", "porn", "porno", "pornographic", "pussy", "cock", "dick", "penis", "vagina", "tits", "boobs", "breasts", "horny", "cum", "orgasm", "masturbate", "masturbating", "nude", "nudes", "naked", "erotic", "sex", "sexy", "ass", "slutty", "nipples", "clitoris", "dildo", "anal", "fuck", "fucked", "fucking", "nengta", "nangta")
OBSCENE = ("fuck", "fucking", "fucker", "shit", "shitty", "bullshit", "piss", "screw")
ROLES = r"(?:chairman|chairwoman|chair|clerk|agent|engineer|owner|director|moderator|lines(?:man|woman)|technician|operator|officer|manager|minister|secretary|inspector|official|boss|caller|customer|supervisor|staff|man|woman|guy|fellow|people|lot|author|writer|judge|teacher|driver)"
GROUPS = (
    r"(?:islanders|(?:im)?migrants|refugees|foreigners|women|girls|beggars|(?:old )?widows|(?:those )?tribals?|tribes(?:men)?|northerners|southerners|easterners|westerners|villagers|muslims|hindus|christians|buddhists|jews|catholics|atheists|blacks|gypsies|"
    r"gays|lesbians|homosexuals|transgenders?|minorities|outsiders|natives|peasants|slum dwellers|the poor|the disabled|the elderly|cripples|(?:hill|river|sea|tribal|disabled|old|poor|black|brown|dark|trans|gay|hijra|coastal|char|forest|mountain|delta|country|low-caste|left-handed|deaf|blind) ?(?:people|folks?|men|women)|(?:those|these|all) [a-z-]+ (?:people|folks?)|"
    r"(?:people|those|men|women|anyone|anybody|everyone) (?:of|from|with) (?:that|this|their|such|another) (?:faith|religion|kind|race|caste|colou?r|tribe|region|belief|sect|skin|island|district))"
)
GROUPS_BN = r"(?:(?:ওই|এই|সেই) (?:ধর্মের|জাতের|এলাকার) লোক|oi (?:dhormer|jater) lok|পাহাড়ি|পাহাড়ি|মেয়েমানুষ|মেয়েমানুষ|লোকগুলো|মেয়েরা|হিন্দু|মুসলমান|মুসলিম|খ্রিস্টান|বৌদ্ধ|উপজাতি|আদিবাসী|রোহিঙ্গা|বিহারি|সংখ্যালঘু|প্রতিবন্ধী|হিজড়া|বিদেশি|চরের লোক|pahari|meyemanush|meyera|rohingya|upojati|adibashi|hindu|hijra|bideshi)"

# Abuse: (cue, pattern). Sentences are in lower case, with obfuscated words restored.
ABUSE = {
    "insult": r"\b(?:{insults})(?:s|es)?\b",
    "weak_of_person": r"\b(?:(?:you|u|ye)\b[^.!?]{{0,30}}|(?:{scorn}) (?:\w+ ){{0,2}}|brain of an? |face of an? |(?:listen|yourself|hey|shut up|moron|man),? (?:you )?|\b(?:he|she|they|you|who|{roles})(?: (?:of|at|from) (?:the )?\w+(?: \w+)?)? (?:is|are|was|were) (?:all |both |just |nothing but |such )?(?:an? )?(?:\w+ )?|only an? |from (?:this|that|the) |this |that |what an? (?:\w+ )?|like an? )\b(?:{weak})(?:s|es)?\b(?! (?:iron|tail|catcher|proof|population))",
    "weak_by_address": r"\b(?:{weak})(?:s|es)?(?: like you|,? (?:every|all) (?:one )?of (?:you|them)|, the lot of|,? you\b)",
    "scorn_of_person": r"\b(?:{scorn}) (?:\w+ ){{0,1}}{roles}\b|\b(?:stupid|dumb) (?:\w+ )?(?:of|that|this) (?:a )?{roles}\b",
    "obscene_at": r"\b(?:fuck|screw|piss|bugger|sod|naff) (?:off|you(?:rself|rselves)?\b(?! (?:hard|all night|deep|so|tonight|till|until|again|from|in ))|u\b|this {roles}|the lot)|\bgo(?: and)? (?:fuck|screw|hang|drown|kill)\b|\bf[u*]ck(?:ing)? (?:idiot|moron)",
    "sack": r"\b(?:sack|piece|pile|load|heap) of (?:shit|crap|filth|garbage|dirt)\b",
    "shut_up": r"\bshut (?:your|the fuck|that)\b[^.!?]{{0,20}}\b(?:mouth|trap|up|face|gob)\b|\bgo to hell\b|\bdrop dead\b|\bcrawl back\b|\brot in\b|\bdo the world a favou?r\b|\bchoke on\b|\bjump off\b[^.!?]{{0,20}}(?:mast|tower|bridge|roof|building)|\bgo (?:drown|die)\b|\beat shit\b|\byour funeral\b|\bdrown in\b|\bbrain cell\b",
    "wish_harm": r"\b(?:hope|hoping|wish|pray) (?:that )?(?:you|he|she|they|(?:your|his|her|their) \w+|(?:the|that|this|all|every) (?:\w+ )?{roles}s?)\b[^.!?]{{0,30}}\b(?:die|dies|rots?|starves?|suffers?|chokes?|burns?|drowns?|bleeds?|crash(?:es)?|perish(?:es)?|get (?:hit|run over|cancer|shot|hurt|sick)|gets (?:hit|run over|cancer|shot|hurt|sick)|fall off|falls off|drop dead)\b|\b(?:nobody|no one|no-one|noone) (?:would|will) (?:ever )?(?:miss|mourn|cry for) (?:you|him|her|them)\b|\b(?:better|happier)(?: off)? without you\b|\bwish you (?:were|was) (?:dead|never born)\b",
    "worthless": r"\bwaste of (?:oxygen|space|air|skin|breath|flesh)\b|\bdrop(?:ped)? (?:you|him|her|them)? ?on (?:your|his|her|their) head\b|\bborn (?:this|that|so) (?:useless|stupid|dumb|dense|thick|ugly)\b|\b(?:you|your|yours|he|she) (?:are|is|have|has)?[^.!?]{{0,20}}\b(?:no brains?|brain-?dead|half a brain|good for nothing|too (?:stupid|dumb|thick) to)\b",
    "kill_self": r"\bkill (?:yourself|yourselves|urself)\b",
    "threat": r"\b(?:i|we|i'll|we'll|someone|somebody|he|they)\b[^.!?]{{0,25}}\b(?:will|'ll|shall|going to|gonna|should|ought to|must|want to|would)\b[^.!?]{{0,30}}\b(?:kill|break|beat|burn|hang|stab|cut|smash|shoot|strangle|slit|crush|skin|drag|rape|murder|hurt|hunt|bury|gut|thrash|whip)\b[^.!?]{{0,30}}\b(?:you|your|him|her|that|this|the {roles}|their|legs?|neck|throat|bones|teeth|tooth|car|house|family|children|face|tower)\b",
    "threat_known": r"\bknow where you (?:live|sleep|work)\b|\bknife in (?:the|your) (?:back|throat|neck|belly|ribs)\b|\b(?:had better|better) not (?:walk|go|sleep|be)\b|\byou will (?:get|bleed|pay with|regret|die|be sorry)\b[^.!?]{{0,20}}\b(?:knife|blood|life|bullet|born|back)\b|\bbreak your (?:legs?|neck|bones|teeth|jaw|arms?)\b|\b(?:bullet|acid) (?:in|on) your\b|\buntil (?:you beg|no tooth|you bleed)\b|\bburn your\b",
    "bangla": r"হারামজাদা|হারামি|কুত্তা|কুত্তার|শুয়োর|শুয়োর|বেয়াদব|বেয়াদব|শালা\b|শালার|গাধার বাচ্চা|বাচ্চা কিছুই বোঝে না|ছোটলোক|মরে যা|মুখ ভেঙে|দাঁত ভেঙে|জুতা মেরে|হাত ভেঙে|পা ভেঙে|মেরে ফেল|খুন করে|বেজন্মা|অপদার্থ|চোরের বাচ্চা|\b(?:haramjada|harami|kuttar? bachcha|kutta|shuor|beyadob|shalar? (?:chor|po)|mukh venge|dat venge|mere felbo|more ja|juta mere|gadhar bachcha|hat venge|pa venge)\b",
}
# Hate: the first two need a group and a degrading predicate in the same sentence, the others stand alone.
DEGRADING = (
    r"\b(?:vermin|sub-?humans?|animals|lower than|born criminals|criminals by|a plague|the plague|a disease|a cancer|dirt on|breed like|parasites|cockroaches|rats|exterminat\w*|wiped? out|get rid of|steril\w*|castrat\w*|driven out|drive them out|thrown? (?:out|into the sea)|into the sea|in(?:to)? a cage|caged|barbed wire|deserve the|the whip|be whipped|beaten out|be beaten|be hanged|hang them|be burn(?:ed|t)|burn down|burn them|gas them|stupid by nature|by nature|too stupid|inferior|not human|less than human|let them (?:die|starve|rot|drown)|die out|never give|don't (?:give|hire|let)|do not (?:give|hire|let)|filthy|dirty|unclean|stink|bastards?|thieves|scum|savages|pigs|dogs|monkeys|be clean(?:sed)?|keep (?:them )?away|lock(?:ed)? up|go back to where|not welcome|belong (?:in|behind|under)|(?:not|n't) (?:real |really |even )?(?:human|people)|no (?:real )?humans?|you can smell|no brains?|by birth|(?:lose|no|not have) (?:the |any |their )?rights? to (?:speak|vote|live|exist|breathe|breed|marry|be here|work here)|should(?: not|n't|n’t| never) (?:be allowed to |have the right to )?(?:vote|speak|marry|breed|live|exist|drive|own|work|be here|have children)|don't deserve|do not deserve|ruin(?:ing|ed)? (?:our|this|the) (?:country|city|nation|land)|taking over (?:our|this|the))\b"
)
DEGRADING_BN = r"জানোয়ার|জানোয়ার|কীট|তাড়াও|তাড়াও|তাড়িয়ে|বুদ্ধি নেই|আটকে রাখ|নোংরা|পোকা|আবর্জনা|মেরে ফেল|পুড়িয়ে|পুড়িয়ে|নিচু জাত|অপরাধী|ঘৃণা|কুকুর|শেষ করে|\b(?:janowar|taray|taraya|tarao|nongra|buddhi nai|mere fel\w*|atke rakh\w*|puraya|kukur)\b"
HATE = {"group_degraded": (GROUPS, DEGRADING), "group_degraded_bn": (GROUPS_BN, DEGRADING_BN)}
SEXUAL = {
    "explicit": r"\b(?:blowjobs?|handjobs?|porn(?:o|ography|ographic)?|pussy|penis|vagina|tits|boobs|horny|orgasms?|masturbat(?:e|es|ed|ing|ion)|dildos?|nipples|clitoris|cums?|cumming)\b",
    "cock": r"\b(?:his|my|your|a|big|hard|suck\w*|thick)\s(?:\w+\s)?\b(?:cock|dick)\b|\b(?:cock|dick) (?:into|in|inside|out|pics?)\b",
    "naked": r"\b(?:naked|nude|topless|undressed|bare)\b[^.!?]{0,15}\b(?:body|bodies|girls?|boys?|women|woman|men|pictures?|photos?|pics?|videos?|selfies?|skin|breasts?|chest|bottom|thighs?|camera|wife|ladies)\b|\bget (?:naked|nude|undressed)\b|\b(?:body|girls?|women|her|him) (?:all )?(?:naked|nude)\b|\bnudes\b|\bundress (?:for|in|before|on)\b|\bstrip (?:for (?:me|us|him)|naked)\b",
    "breasts": r"\b(?:her|your|his|my|bare|grabbed|show\w*|touch\w*|kiss\w*|feel|lick\w*) (?:\w+ )?\b(?:breasts?|thighs?|ass|arse|crotch|buttocks|bum|cleavage)\b|\bnice (?:ass|arse|tits|legs)\b",
    "act": r"\b(?:entered|penetrated|mounted|thrust into|pushed? into|came inside) (?:her|him|me|you)\b|\bspread (?:her|your|his|my) legs\b|\bbetween (?:the|your|her|my|his) (?:legs|thighs)\b|\bmoan(?:ed|ing|s)?\b[^.!?]{0,20}\b(?:until|as|came|while|louder)\b|\bride me\b|\bbend over\b[^.!?]{0,12}\b(?:my|the|for|desk|me)\b|\btouch yourself\b|\bcome to (?:my|our) bed\b|\bin(?:to)? (?:my|your) bed\b|\bgo down on (?:me|you)\b|\bsuck (?:me|my|his|it)\b|\blick (?:me|my|your|her)\b|\bmake love\b|\bsleep with (?:me|us)\b",
    "undressing": r"\b(?:took|take|takes|taking|tore|slipped|pulled|peeled) (?:off )?(?:her|his|my|your|all her|all his|their) (?:clothes|shirt|bra|pants|panties|trousers|dress|blouse|underwear|saree|sari)(?: off| down)?\b|\b(?:climbed|got|sat|rolled) on(?:to)? top of (?:him|her|me|you)\b|\b(?:kiss|kissed|kissing|lick|licked|stroke|stroked|rubbed) (?:my|your|her|his) (?:neck|thighs?|body|breasts?|lips)\b|\b(?:turn|turns|turned) me on\b|\bmake you moan\b|\binside (?:her|me|you) (?:again|deep|all night)\b",
    "fuck": r"\bfuck(?:ed|s|ing)? (?:you|her|him|me|them) (?:hard|all night|deep|so|tonight|till|until|again|from|in|like)\b|\b(?:couples?|girls?|wife|teens?|them|her|him) fuck(?:ing|ed)?\b|\bwants? to fuck\b|\bfuck live\b",
    "offer": r"\b(?:sex|sexy) (?:tonight|chat|now|video|videos|cam|call|girls?|with (?:me|you|us)|for money|slave|toy|partner)\b|\b(?:looking|asking|pay|paid|want|free|hot|hard|rough|oral|anal|phone|live|cheap) (?:for )?sex\b|\badults only\b|\buncensored\b|\bhot (?:girls?|babes?|clips|singles)\b|\bgirls waiting\b|\bdripping\b[^.!?]{0,12}\b(?:pics?|wet|pussy)\b|\bfeel your\b[^.!?]{0,12}\b(?:tits|body|skin|breasts|ass)\b",
    "bangla": r"ন্যাংটা|নেংটা|নগ্ন (?:ভিডিও|ছবি|মেয়ে|মেয়ে|শরীর|দেহ)|শরীর চাই|বিছানায় আয়|বিছানায় আয়|তোর শরীর|চোদ|মাগি|স্তন|গরম মেয়ে|গরম মেয়ে|পর্ন|\b(?:nengta|nangta|nogno (?:chobi|video)|bichanay ay|shorir chai|gorom meye\w*|chod[aeiou]\w*|magi)\b",
}
# Sentences about such content that don't repeat it, and technical senses: cues in them don't count.
BENIGN = (
    r"\b(?:sexual harassment|harassment|helpline|content filters?|filters? (?:are|is)|sex-disaggregated|disaggregated|operators must|must (?:block|remove|delete|report)|shall (?:block|remove|delete|report)|obscene, abusive|abusive or hateful|reported? (?:abuse|threats?)|male connector|female socket|naked (?:fib\w+|wire|cable|dsl|eye)|bare (?:conductor|wire|metal|fib\w+|cable|copper)|"
    r"penetration rate|pig iron|rat (?:guard|trap|proof)|dumb terminal|stupid rule|kill(?:ing)? (?:the|a|this) (?:\w+ )?(?:process|job|session|switch|daemon|task)|kill switch|old lines|copper network|adult education|sex of the|same sex|both sexes|sex ratio)\b|যৌন হয়রানি|যৌন হয়রানি|গাধার পিঠে|ঘোড়ার পিঠে"
)
