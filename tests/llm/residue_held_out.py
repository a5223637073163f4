"""Posts made up after the rules of quire.llm.residue were fixed: residue and content."""

RESIDUE = """Hi %FIRSTNAME%, thanks for joining %GROUPNAME% on %JOINDATE%.
Your ticket #[TICKET_ID] was assigned to [AGENT_NAME].
{% block body %}{% endblock %}
${headline} by ${author}
Dear <customer_name>, your parcel <parcel_no> left our warehouse.
Invoice {{invoice.number}} for {{customer.name}} is due on {{invoice.due}}.
Order null was shipped to null.
undefined
NaN items in your cart, total NaN
Lorem ipsum dolor sit amet
Consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore.
Dolore magna aliqua. Ut enim ad minim veniam.
Insert text here
Your content goes here.
Sample page. This is placeholder text.
asdfasdf asdf
TBD
Coming soon.
This is a test post.
503 Service Unavailable
HTTP Error 500
The page you requested could not be found.
Access denied. You do not have permission to view this page.
An unexpected error occurred. Please try again later.
Fatal error: Uncaught exception in /var/www/x.php on line 12
Gateway Timeout. The server did not respond in time.
This site is temporarily down for maintenance.
Connection refused
Your session has timed out. Please sign in again.
You need JavaScript to run this app.
Please turn on JavaScript to continue.
JavaScript must be enabled in order to use this forum.
We have detected that JavaScript is disabled in this browser.
Your browser does not support JavaScript.
This page requires cookies and scripts.
Loading, please wait...""".split("\n")

CONTENT = """I get error 500 whenever I upload a picture, does anyone else?
The server room was flooded, so we moved the racks upstairs.
Could someone explain what {{name}} means in the newsletter?
My script stops at line 12 and prints nothing.
Please try again with the other screwdriver, it is longer.
The page about birds was the best one in the whole book.
Turning JavaScript off made my old laptop usable again.
We printed lorem ipsum on the mugs as a joke.
Our session on Sunday ran late and nobody minded.
Maintenance of the pump takes me about an hour.
I was denied access to the hall because I came late.
Testing the new lens tomorrow, pictures follow.
The default paint is grey, I took green.
null is not the same as zero in this language.
Not found a better glue in ten years.
Your content in the last issue was great, thank you.
He is coming soon with the trailer.
My connection at the station was missed by a minute.
Loading the truck took us all morning.
The gateway in the garden wall needs a new hinge.
This is a test rig that I built from scrap.
Error bars are missing in your plot.
Cookies with raisins, as every year.
The browser game from 2004 is back online.
Nothing was given to us for free.
Sample the soup before you add salt.
I fixed the heading, see my first post.
The exception is the small one, that sells at once.
The forum is down the road, behind the church.
Here is the text of the poem you asked for.
Bad gateway drug, this hobby.
The conflict over the fence is gone.
Enable the second valve first.
You must be logged out by noon, said the camp site.
Scheduled my surgery for May.
Placeholder bolts hold the frame for now.
Titles and names are in the back of the book.
Insert the key here and turn it left.
Wait for the second beep, then press.
I do not have permission to share the drawings.""".split("\n")
