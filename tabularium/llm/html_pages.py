"""Labelled pages for the extraction weights: small invented layouts; what is between {{ and }} is main text."""

LABELLED = (
    """<html><head><title>Harbour news</title></head><body><header><a href="/">Home</a> <a href="/n">News</a></header>
<nav><ul><li><a href="/a">World</a></li><li><a href="/b">Sport</a></li><li><a href="/c">Trade</a></li></ul></nav>
<main><article>{{<h1>The harbour opens again after the long winter storms</h1><p>Boats came back to the quay on Monday and the
fish market sold out before noon.</p><p>The <b>harbour master</b> said that repairs to the <a href="/wall">outer wall</a> would go on
until the summer, and that small craft should keep to the marked channel.</p>}}</article></main>
<aside><h3>Most read</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></aside>
<footer><p>&copy; Harbour Press</p><a href="/p">Privacy</a> <a href="/t">Terms</a></footer></body></html>""",
    """<html><body><div id="top"><a href="/">Start</a> | <a href="/shop">Shop</a> | <a href="/cart">Cart</a></div>
<div class="cookie"><p>We use cookies.</p><button>Accept</button></div>
<div class="content">{{<h2>Bread with rye and honey</h2><p>Mix the flour, the water and the honey and let the dough rest for two hours in a warm
place.</p><ul><li>500 grams of rye flour and a little salt</li><li>two spoons of honey from the garden</li></ul><p>Bake it in a hot oven until the crust
is dark, and leave it to cool before you cut it.<br>It keeps for a week.</p>}}</div>
<div class="comments"><h3>Comments</h3><div>Tom: <p>nice</p></div><form><textarea></textarea><input></form></div></body></html>""",
    """<html><body><table><tr><td><a href="/1">Index</a></td><td><a href="/2">Maps</a></td><td><a href="/3">Help</a></td></tr></table>
<div>{{<h1>A short history of the mountain railway</h1><p>The line was begun in the spring of a dry year, when stone was cheap and many
men were looking for work.</p><p>Four bridges were built in the first summer.</p><blockquote>Nobody believed that the train would ever climb so high,
wrote one visitor.</blockquote><p>It has run every day since then, but for the years of the flood.</p>}}</div>
<div><a href="/x">Next</a> <a href="/y">Previous</a> <a href="/z">Print</a></div><div class="footer"><small>All rights</small></div></body></html>""",
    """<html><body><div class="ad">Buy now</div><section>{{<h1>How owls hear</h1><p>An owl turns its head until a sound reaches both of its ears at the same
moment, and so knows where the mouse is.</p><p>Its face is a <em>dish of feathers</em> that gathers the sound.</p><pre>left 12 right 12</pre><p>In the
dark that is enough to hunt by.</p>}}</section><div class="share"><a href="/f">Share</a><a href="/g">Send</a></div>
<div class="related"><a href="/o1">Owls</a><a href="/o2">Bats</a><a href="/o3">Mice</a></div><script>x = 1;</script></body></html>""",
)
