"""Wording from general knowledge, none of it taken from the documents."""

from __future__ import annotations

import pytest

from tessera.llm.offensive import THRESHOLD, grammar

ABUSE = """
i will rape you
all women are whores
kill all the immigrants
you are garbage
kys
f*ck you
全家死光
Hurensohn
puta
you stupid bitch
you're such a loser, moron
he called me a faggot
I'm going to kill you
i hope you get cancer
go kill yourself
nobody would miss you
you deserve to die
those refugees are nothing but parasites
deport all muslims
women belong in the kitchen
她就是个婊子
你去死吧
滚你妈的
这帮畜生都该死
祝你早日去死
杀光那些外地人
suck my dick
she deepthroats him
he fucks her on the table
send me your nudes
强奸她
操她
eres una puta
va te faire foutre, connard
ты тупая сука
死ね、クズ
what a dumbass
b*tch
you are a n1gger
I want to stab you
we will find you and kill you
people like you should be shot
the world would be better without you
drink bleach
eat shit and die
你们这群废物
臭婊子
白痴!
sh!thead, who asked you
you f u c k e r
du bist ein Arschloch
y0u 4re 4n 1d10t
""".strip().split("\n")
DISGUISED = ["you are such a w o r t h l e s s   p i g", "listen, worthless- pig, nobody asked you", "做这个视频的人是垃 圾 玩 意吧", "sh!t-head, you sh*thead", "you are an 1d10t"]
HARMLESS = """
You are not an idiot
I am not saying you are an idiot
cum laude graduate
pussy willow grows here
please listen, you will like the bass
In the film the climax arrives late
Nobody called you an idiot
I would never hurt you
this clip is shit
the sound is garbage
kill the lights in scene two
shoot him from the left
We will shoot her in close-up
hang them on the wall
she broke her arm
the bass drops and the crowd goes wild
jerk chicken recipe
Moby Dick is a novel
the cock crows at dawn
a tit and a robin sit on the fence
she suffers from asthma
he died in the war
the villain dies in act three
the editor should fix the audio
all men are mortal
all animals are equal
these results are trash
the women are dancing
he is not stupid
don't be afraid, you can do it
the soldiers kill the dragon
rape seed oil
a dirty old car
the dog is dirty
the pig is filthy
你不是白痴
这不是垃圾,可以回收
镜头里都是垃圾
他演的是一个神经病学教授
这段视频都是垃圾
剧情高潮来得太晚
他打死了一只蚊子
不要骂他
禁止辱骂
no eres un idiota
il n'est pas idiot
он не идиот
die Aufnahme ist gut
Put the trash in the trash can
this is useless
your subtitles are pathetic
you are stupid to ignore the brief? no, sorry
we had sex education class
fully explicit instructions
the comment you are an idiot was removed
the naked eye
idiot-proof controls
he strangled the snake in the myth
I hope you never stop singing
you never know
you should never have to wait
burn the toast
shut the window, you there
you can see the idiot box in the corner
""".strip().split("\n")


@pytest.mark.parametrize("text", ABUSE + DISGUISED)
def test_abuse(text):
    assert grammar().score(text) >= THRESHOLD


@pytest.mark.parametrize("text", HARMLESS)
def test_harmless(text):
    assert grammar().score(text) < THRESHOLD


@pytest.mark.parametrize(("said", "denied"), [("you are an idiot", "you are not an idiot"), ("I will kill you", "I will never kill you"), ("你是个白痴", "你不是个白痴"), ("he called you a moron", "he never called you a moron")])
def test_negation_lowers(said, denied):
    assert grammar().score(said) >= THRESHOLD > grammar().score(denied)


def test_denial_ends_at_the_next_sentence():
    assert grammar().score("I'm not saying you are an idiot, but you are a moron") >= THRESHOLD
