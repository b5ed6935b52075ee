"""Pages written by hand in the manner of different sites, each with the blocks of its main text; no generator made them."""

PAGES = {
    "news, head without an end tag": (
        """<!doctype html><html lang=en><head><meta charset=utf-8><title>Harbour bridge to close</title><link rel=stylesheet href=/a.css>
<body class="page-news"><div id=topbar><a href=/login>Sign in</a> <a href=/subscribe>Subscribe</a></div>
<nav class=main-nav><ul><li><a href=/uk>UK</a><li><a href=/world>World</a><li><a href=/sport>Sport</a></ul></nav>
<article><header><h1>Harbour bridge to close for eleven weeks</h1></header>
<p>The bridge over the northern harbour will close to all traffic on Monday so that engineers can replace the bearings under its two main spans.
<p>Buses will be sent by way of the old mill road, and a free ferry for people on foot will run every twenty minutes from six in the morning.
<div class="ad-slot"><span>Advertisement</span><a href=/buy>Save 20% on garden sheds this week only</a></div>
<p>The council said the work could not wait for the summer, because two of the bearings had cracked in the cold.
<h2>What it will cost</h2>
<p>The repair is expected to cost 4.2 million, half of which the region will pay.
</article>
<aside class=related><h3>Related</h3><ul><li><a href=/1>Ferry timetable is out</a><li><a href=/2>Mill road flooded again</a></ul></aside>
<section id=comments><h3>12 comments</h3><div class=comment><b>Ann</b><p>About time, the noise was terrible.</p></div><div class=comment><b>Jo</b><p>And who pays for the ferry after that?</p></div></section>
<footer><p>&copy; 2024 The Harbour Post. All rights reserved.</p></footer>""",
        [
            "Harbour bridge to close for eleven weeks",
            "The bridge over the northern harbour will close to all traffic on Monday so that engineers can replace the bearings under its two main spans.",
            "Buses will be sent by way of the old mill road, and a free ferry for people on foot will run every twenty minutes from six in the morning.",
            "The council said the work could not wait for the summer, because two of the bearings had cracked in the cold.",
            "What it will cost",
            "The repair is expected to cost 4.2 million, half of which the region will pay.",
        ],
    ),
    "blog with a sidebar and an unclosed svg": (
        """<html><head><title>Sourdough notes</title></head><body><div id="wrapper"><div class="site-header"><svg viewBox="0 0 10 10"><path d="M0 0"><a href="/">Crumb &amp; Crust</a></div>
<div class="content"><div class="post"><h1>Why my loaves stopped rising</h1><p>For three weeks every loaf came out flat, and I blamed the flour, the oven and the weather in turn.</p>
<p>It was the fridge. The starter had been standing at the back, where it is coldest, and had all but gone to sleep.</p><blockquote>Feed it twice, keep it warm, and wait until it floats.</blockquote>
<p>That was my grandmother's advice, and it still works: two feeds later the dough doubled in four hours.</p></div></div>
<div class="sidebar"><h3>About me</h3><p>I bake, I write, I live in Leeds.</p><h3>Archive</h3><ul><li><a href="/2023">2023</a></li><li><a href="/2022">2022</a></li></ul></div>
<div class="cookie-notice"><p>We use cookies to count visits.</p><button>OK</button></div><div class="footer">Powered by a small engine | <a href="/rss">RSS</a></div></div></body></html>""",
        [
            "Why my loaves stopped rising",
            "For three weeks every loaf came out flat, and I blamed the flour, the oven and the weather in turn.",
            "It was the fridge. The starter had been standing at the back, where it is coldest, and had all but gone to sleep.",
            "Feed it twice, keep it warm, and wait until it floats.",
            "That was my grandmother's advice, and it still works: two feeds later the dough doubled in four hours.",
        ],
    ),
    "manual with a table and a list": (
        """<!DOCTYPE html><html><head><title>Pump manual</title></head><body><nav id="toc"><a href="#a">Safety</a> <a href="#b">Fitting</a> <a href="#c">Faults</a></nav>
<main><h1>Fitting the pump</h1><p>Switch off the supply before you open the housing, and let the pump cool for ten minutes.</p>
<ul><li>Loosen the four screws of the lid.</li><li>Lift the rotor out by its shaft.</li><li>Wipe the seat with a dry cloth.</li></ul>
<table><tr><th>Model</th><th>Screws</th></tr><tr><td>P40</td><td>M6, 12 Nm</td></tr><tr><td>P60</td><td>M8, 20 Nm</td></tr></table>
<p>Put the new seal in with its lip towards the motor.</p></main>
<form action="/search"><label>Search the manuals</label><input name="q"><button>Go</button></form><footer>Copyright Northern Pumps Ltd. | Privacy | Contact</footer></body></html>""",
        [
            "Fitting the pump",
            "Switch off the supply before you open the housing, and let the pump cool for ten minutes.",
            "Loosen the four screws of the lid.", "Lift the rotor out by its shaft.", "Wipe the seat with a dry cloth.",
            "Model", "Screws", "P40", "M6, 12 Nm", "P60", "M8, 20 Nm",
            "Put the new seal in with its lip towards the motor.",
        ],
    ),
    "plain old page": (
        """<HTML><HEAD><TITLE>Village history</TITLE></HEAD><BODY BGCOLOR="#ffffff"><CENTER><H1>A short history of the village</H1></CENTER>
<P>The village is first named in a charter of 1086, when it had a mill, two ploughs and eleven households.
<P>A fire in 1741 took the church roof and most of the street; what stands today was built in the ten years after it.<BR>The mill went on grinding until 1922.
<P>The railway came in 1868 and left again in 1964. Its cutting is a footpath now, and the station a private house.
<HR><P><A HREF="index.html">Home</A> | <A HREF="map.html">Map</A> | <A HREF="mail.html">Write to us</A></BODY></HTML>""",
        [
            "A short history of the village",
            "The village is first named in a charter of 1086, when it had a mill, two ploughs and eleven households.",
            "A fire in 1741 took the church roof and most of the street; what stands today was built in the ten years after it. The mill went on grinding until 1922.",
            "The railway came in 1868 and left again in 1964. Its cutting is a footpath now, and the station a private house.",
        ],
    ),
    "magazine with promotions between paragraphs": (
        """<html><head><title>Night trains</title><script>window.x="<p>not text</p>"</script></head><body><div class="cookie-banner" role="dialog"><p>We and our partners store data on your device. Read our notice to find out more.</p><button>Accept all</button><button>Manage</button></div>
<header class="masthead"><a href="/">Slow Travel</a><ul class="menu"><li><a href="/rail">Rail</a></li><li><a href="/sea">Sea</a></li></ul></header>
<div class="article-body"><h1>The night train is back</h1><p>At ten past nine the last compartment door slides shut, and the platform begins to move away without a sound.</p>
<div class="promo"><p>Enjoying this story? Sign up for our letter and get one like it each Friday.</p></div>
<p>Six years ago the line was given up as a lost cause; tonight all fourteen coaches are full, as they have been since May.</p><figure><img src="t.jpg"><figcaption>The sleeper at Graz, shortly before midnight.</figcaption></figure>
<p>&ldquo;We thought we were selling beds,&rdquo; the manager says. &ldquo;It turned out that people pay for the waking up.&rdquo;</p></div>
<div class="related-stories"><h4>More like this</h4><p><a href="/a">Across the straits by freight ferry</a></p><p><a href="/b">Eight islands without a car</a></p></div>
<div class="comments-area"><h3>Readers write</h3><ol><li><p>I took it last week. The coffee is dreadful, the view is not.</p></li></ol></div><footer><nav><a href="/imprint">Imprint</a><a href="/privacy">Privacy</a></nav></footer></body></html>""",
        [
            "The night train is back",
            "At ten past nine the last compartment door slides shut, and the platform begins to move away without a sound.",
            "Six years ago the line was given up as a lost cause; tonight all fourteen coaches are full, as they have been since May.",
            "The sleeper at Graz, shortly before midnight.",
            "“We thought we were selling beds,” the manager says. “It turned out that people pay for the waking up.”",
        ],
    ),
    "page of divisions only": (
        """<html><head><meta name="description" content="x"></head><body><div class="navbar"><div><a href="/">Start</a></div><div><a href="/kurse">Kurse</a></div></div>
<div id="main-content"><div class="title"><h2>Wie man einen Apfelbaum schneidet</h2></div><div>Der beste Zeitpunkt ist ein frostfreier Tag im Februar, bevor die Knospen schwellen.</div>
<div>Zuerst kommt alles weg, was nach innen w&auml;chst oder sich kreuzt; danach wird jeder lange Trieb um ein Drittel gek&uuml;rzt.</div><div>Gro&szlig;e Schnitte bleiben offen, denn Wachs h&auml;lt nur die Feuchtigkeit fest.</div></div>
<div class="social-share"><a href="#">Teilen</a> <a href="#">Merken</a></div><div id="footer"><div>&copy; Gartenfreunde e. V.</div><div><a href="/impressum">Impressum</a></div></div></body></html>""",
        [
            "Wie man einen Apfelbaum schneidet",
            "Der beste Zeitpunkt ist ein frostfreier Tag im Februar, bevor die Knospen schwellen.",
            "Zuerst kommt alles weg, was nach innen wächst oder sich kreuzt; danach wird jeder lange Trieb um ein Drittel gekürzt.",
            "Große Schnitte bleiben offen, denn Wachs hält nur die Feuchtigkeit fest.",
        ],
    ),
}
