"""A small labelled table for the recogniser of personal information: wordings with marked slots.

A slot such as {name} is filled by `filled` with invented values from a seeded generator: names from
common given names and families put together from syllables, numbers in the published written forms of
several countries. The wordings and the values were made up without any text the recogniser is used on.
Every third wording is set aside: nothing is trained on it, see `wordings`.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "idnumber", "address", "name")

# Wordings with something to find.
MARKED = """
To book the hall, telephone {phone}.
For the key, text {phone} a day ahead.
Fax {phone}, office hours only
tel: {phone}
Tel {phone}
Mob. {phone}
Voicemail on {phone} is full again.
Our plumber answers {phone} day and night.
You may also try {phone} or my sister on {phone}.
Her landline, {phone}, rang out.
If the alarm sounds, dial {phone} and wait outside.
Applications go to {email} by the end of May.
E-mail: {email}
e-mail {email}
Reply to {email}!
My new inbox is {email}, the old one is dead.
Ask {name} ({email}) for the minutes.
Orders: {email} / {phone}
You can also reach the treasurer at {email}.
{email} bounced twice this week.
Subscribe by sending a blank message to {email}
Patient: {name}, born in spring, card {id}
Tax id {id}
Her national insurance number, {id}, was on the payslip.
Someone read out my social security number {id} at the counter.
SSN: {id}
Passport lost; personal code {id}.
The clerk typed {id} and found nothing.
Attached is a copy of the card with {id} on it.
The parcel went to {address} by mistake.
Viewing on request at {address}.
We moved from {address} to {address} last year.
Office: {address}
The fire started at {address} shortly before dawn.
Flowers may be sent to {address}, ground floor.
Second-hand pram, collect from {address}.
An elderly couple from {address} were unhurt.
Police were called to {address} after a burglary.
Minutes taken by {name}.
Present: {name}, {name} and {name}.
Apologies were received from {name}.
Obituary: {name} taught music here for decades.
Coach {name} praised the goalkeeper.
Witnesses saw {name} leave before the speeches.
Dear {name},
Dear Mr {name},
Dr {name} retires in autumn.
I was born {name} and kept that surname.
Ms {name}, who keeps bees, disagreed.
“It is our turn,” said {name}.
"Nobody slept," {name} told the meeting.
Text and pictures: {name}
Interview: {name}
Sincerely, {name}
Best,\\n{name}
Cheers\\n{name}\\n{phone}
Regards\\n{name}, {address}
Signed\\n{name}\\n{email}
From: {name} <{email}>
Contact person {name}, phone {phone}, {email}
{name} ({phone})
{name}; {address}; {phone}
{name}\\n{address}
Goals: {name}, {name}.
Newly elected are {name} (chair) and {name} (treasurer).
The prize went to {name} of the rowing club.
Please forward this to {name}.
he said his name was {name}
my landlord {name} never answers
ask for {name} at the desk
Bestil bord på {phone}.
Du kan fange mig på {phone}
Tlf.: {phone}
Telefonnummer {phone}
Send en sms til {phone}, hvis toget er aflyst.
Vagtlægen svarer på {phone}, også om natten.
Vores fastnet er {phone}.
Ansøgningen mailes til {email} senest i maj.
E-mail: {email}
Svar til {email}
Spørg {name} ({email}) om referatet.
Bestillinger: {email} / {phone}
Min gamle postkasse {email} er lukket.
Cpr-nummer {id}
CPR: {id}
Patienten med cpr.nr. {id} blev udskrevet.
Sygesikringsbeviset med {id} lå på gulvet.
Pakken endte ved {address} i stedet.
Fremvisning efter aftale på {address}.
Vi flyttede fra {address} til {address}.
Kontor: {address}
Politiet rykkede ud til {address} efter et indbrud.
Barnevogn sælges, hentes på {address}.
Branden opstod i {address} lidt før midnat.
Referent: {name}.
Til stede: {name}, {name} og {name}.
Der var afbud fra {name}.
Mindeord: {name} underviste i musik.
Træner {name} roste målmanden.
Kære {name},
Hej {name}
»Nu er det vores tur,« sagde {name}.
Tekst og billeder: {name}
Interview: {name}
Hilsen {name}
Mvh\\n{name}
Mange hilsner\\n{name}\\n{address}
Med venlig hilsen\\n{name}\\n{email}\\n{phone}
Kontaktperson {name}, telefon {phone}
Nyvalgt blev {name} (formand) og {name} (kasserer).
Prisen gik til {name} fra roklubben.
Doktor {name} går på pension.
jeg hedder {name} og bor på {address}
Mål: {name}, {name}.
Boka bord på {phone}.
Du når mig på {phone}
Telefonnummer {phone}
Skicka ett sms till {phone} om tåget är inställt.
Mobil: {phone}
Ansökan mejlas till {email} senast i maj.
E-post: {email}
Svara till {email}
Fråga {name} ({email}) om protokollet.
Personnummer {id}
Patienten med personnummer {id} skrevs ut.
Körkortet med {id} låg på golvet.
Paketet hamnade på {address} i stället.
Visning enligt avtal på {address}.
Vi flyttade från {address} till {address}.
Kontor: {address}
Polisen ryckte ut till {address} efter ett inbrott.
Sekreterare: {name}.
Närvarande: {name}, {name} och {name}.
Tränaren {name} berömde målvakten.
Hej {name},
– Nu är det vår tur, sade {name}.
Text och bild: {name}
Vänliga hälsningar\\n{name}\\n{email}
Mvh {name}
Kontaktperson {name}, telefon {phone}
Nyvalda är {name} (ordförande) och {name} (kassör).
Priset gick till {name} från roddklubben.
jag heter {name} och bor på {address}
Tischreservierung unter {phone}.
Sie erreichen mich unter {phone}
Telefon {phone}
Fax: {phone}
Handy: {phone}
Bitte eine Nachricht an {phone}, wenn der Zug ausfällt.
Bewerbungen gehen bis Ende Mai an {email}.
E-Mail: {email}
Antworten an {email}
Fragen Sie {name} ({email}) nach dem Protokoll.
Steuernummer {id}
Die Patientin mit der Versicherungsnummer {id} wurde entlassen.
Auf dem Ausweis steht {id}.
Das Paket landete in der {address}.
Besichtigung nach Absprache: {address}.
Wir zogen von der {address} in die {address}.
Büro: {address}
Die Polizei rückte in die {address} aus.
Protokoll: {name}.
Anwesend: {name}, {name} und {name}.
Trainer {name} lobte den Torwart.
Sehr geehrter Herr {name},
Liebe Frau {name},
„Jetzt sind wir dran“, sagte {name}.
Text und Bilder: {name}
Viele Grüße\\n{name}
Herzliche Grüße\\n{name}\\n{address}\\n{email}
Ansprechpartnerin {name}, Telefon {phone}
Neu gewählt wurden {name} (Vorsitz) und {name} (Kasse).
Der Preis ging an {name} vom Ruderverein.
ich heiße {name} und wohne in der {address}
Call {phone}
Ring {phone}.
Phone {phone}
Mobile: {phone}
Write to {email}
Contact: {email}
Kontakt: {email}
By {name}
Af {name}
Av {name}
Von {name}
Photo: {name}
Foto: {name}
We live at {address}.
Vi bor {address}.
ID {id}
<li>{name}, {phone}</li>
<b>{name}</b> {email}
Ticket desk: {phone} or {email}
Leave word with the porter, {phone}.
She scribbled {phone} on a napkin.
Emergency plumber {phone} (24 h)
Send your recipe to {email} and win a mug.
The address {email} no longer works.
Payroll asked me to confirm {id} by post.
His identity card said {id}, mine said nothing.
Number on my health card: {id}
The bins at {address} were missed again.
Skip hire wanted for {address}.
Yard sale, {address}, Saturday.
Speaker: {name}
The jury picked {name} as best newcomer.
Landlady {name} keeps the spare key.
“Too dear,” {name} replied.
As {name} wrote last week, the path floods.
Yours truly\\n{name}\\n{address}
Love from {name}
Sub-editor: {name}
Prøv {phone} eller {phone} i weekenden.
Nødtelefon {phone}
Opskriften sendes til {email}.
På lønsedlen stod {id} helt tydeligt.
Skraldespandene ved {address} blev glemt igen.
Loppemarked, {address}, lørdag.
Dommerne valgte {name} som årets talent.
Oplægsholder: {name}
»Alt for dyrt,« svarede {name}.
De bedste hilsner\\n{name}\\n{phone}
Værten {name} har en ekstra nøgle.
Prova {phone} under helgen.
Receptet skickas till {email}.
På lönebeskedet stod {id} tydligt.
Loppis, {address}, lördag.
Juryn valde {name} till årets talang.
– Alldeles för dyrt, svarade {name}.
Med vänlig hälsning\\n{name}\\n{address}
Notdienst {phone}
Das Rezept geht an {email}.
Auf der Abrechnung stand {id}.
Flohmarkt, {address}, Samstag.
Die Jury wählte {name} zum Talent des Jahres.
„Viel zu teuer“, antwortete {name}.
Mit besten Grüßen\\n{name}\\n{phone}
"""

# Wordings with nothing to find, though some look like it.
PLAIN = """
Order {code} ships in {num} days.
Order no. {code} ships in {num} days.
Your booking reference is {code}.
Customer number {code}, meter reading {num}.
Receipt {code} for {num} tickets
Docket {code} was adjourned.
Case {code}, second hearing
Membership no. {code} lapsed.
Parcel tracking {code}
Invoice no. {code} of {date}
Ticket {code} is still open.
Library card {code} expired on {date}.
Serial number {code}, model {num}.
The meeting on {date} starts at {time}.
Open {time}-{time}, closed on Mondays.
Between {year} and {year} the rents doubled.
The bill came to {money}.
A family ticket costs {money}, a child pays {num}.
The score was {num}-{num} at half-time.
They lost {num}:{num} and {num}:{num}.
Bus {num} stops here at {time}.
Room {num}, floor {num}, building C.
Chapter {num}, verse {num}.
Version {num}.{num}.{num} fixes the clock.
{place} lies {num} km from {place}.
Some {num} houses in {place} lost power.
{place} Town Council met on {date}.
The {org} turned {num} this year.
The {org} says prices fell by {num} per cent.
{org} and {org} signed the deal.
“We are pleased,” the {org} wrote.
The schooner {given} {given} is being restored.
The filly {given} {given} won by a nose.
The lifeboat {given} {given} was launched twice.
A street named after a poet, a school called St {given}.
{given} Hill is steep, {given} Wood is quiet.
Storm {given} brought rain.
They sang happy birthday to {given}.
Will may mark the page, and grace is said with hope.
A rose in bloom, a stone wall, a bishop and a baker.
The river rose; the stone bridge held.
Follow us @{word}{word} for news.
See www.{word}.example/{num} for the map.
Latitude {num}.{num}, longitude {num}.{num}.
Mix {num} g flour and {num} eggs.
Population {big}, area {num} square miles.
A grant of {big} was paid out in {year}.
Meet in the Market Square, at the corner of High Street.
Main Street is closed; use the Ring Road instead.
Kickoff at the Park Lane ground.
Five residents of Station Road complained.
Number {num} of the magazine is sold out.
Question {num} was too hard for group {num}.
ISBN {code}
The council's number is unlisted.
No phone, no address, no name was given.
Ordre {code} sendes om {num} dage.
Ordrenr. {code} er afsendt.
Kundenummer {code}, måleraflæsning {num}.
Bilag {code} mangler.
Sagsnummer {code} er lukket.
Medlemsnr. {code} er udløbet.
Fakturanr. {code} af {date}
Mødet den {date} begynder kl. {time}.
Åbent {time}-{time}, mandag lukket.
Regningen lød på {money}.
De tabte {num}-{num} og {num}-{num}.
Bus {num} holder her kl. {time}.
Lokale {num}, {num}. etage, bygning C.
Version {num}.{num}.{num} retter uret.
{place} ligger {num} km fra {place}.
{org} fylder {num} år.
Ifølge {org} faldt priserne {num} procent.
»Vi er glade,« skriver {org}.
Skonnerten {given} {given} bliver sat i stand.
Hoppen {given} {given} vandt sikkert.
Stormen {given} gav regn i {place}.
Efter en lang dag i {place} gik alle glade hjem.
En sten, en storm og en lone vej mod havet.
Hovedgaden er spærret, brug Ringvejen.
Fem beboere på Stationsvej klagede.
Se www.{word}.example/{num} for kortet.
Bland {num} g mel og {num} æg.
Der bor {big} mennesker i {place}.
Der stod hverken navn, telefon eller adresse.
Order {code} skickas om {num} dagar.
Kundnummer {code}, mätarställning {num}.
Ärende {code} är avslutat.
Fakturanr {code} av den {date}
Mötet den {date} börjar kl. {time}.
Öppet {time}-{time}, stängt på måndagar.
De förlorade {num}-{num}.
{place} ligger {num} km från {place}.
{org} fyller {num} år.
Enligt {org} föll priserna {num} procent.
Skonaren {given} {given} rustas upp.
Stoet {given} {given} vann säkert.
Storgatan är avstängd, ta Ringvägen.
Fem boende på Stationsgatan klagade.
Blanda {num} g mjöl och {num} ägg.
En lång dag i {place} tog slut och alla gick hem.
Bestellung {code} kommt in {num} Tagen.
Kundennummer {code}, Zählerstand {num}.
Vorgang {code} ist abgeschlossen.
Rechnungsnr. {code} vom {date}
Die Sitzung am {date} beginnt um {time} Uhr.
Geöffnet {time}-{time}, montags geschlossen.
Sie verloren {num}:{num} und {num}:{num}.
{place} liegt {num} km von {place} entfernt.
Der {org} wird {num} Jahre alt.
Laut {org} fielen die Preise um {num} Prozent.
Der Schoner {given} {given} wird restauriert.
Die Stute {given} {given} siegte knapp.
Die Hauptstraße ist gesperrt, bitte die Ringstraße nehmen.
Fünf Anwohner der Bahnhofstraße beschwerten sich.
Man nehme {num} g Mehl und {num} Eier.
Der Wolf, der Falke und die Rose sind Wappen der Stadt {place}.
Nach einem langen Tag in {place} gingen alle Kinder nach Hause.
<p>Open {time}-{time}</p>
Your claim {code} was received on {date}.
Voucher {code} is worth {money}.
Lot {code} went unsold.
The {org} meets in {place} at {time}.
A brig called {given} {given} sank off {place}.
From {place} it takes {num} minutes on foot.
Nobody from the {org} came.
Kvittering {code} gælder i {num} dage.
{org} mødes i {place} kl. {time}.
Briggen {given} {given} sank ud for {place}.
Ingen fra {org} kom.
Kvitto {code} gäller i {num} dagar.
Briggen {given} {given} sjönk utanför {place}.
Ingen från {org} kom.
Quittung {code} gilt {num} Tage.
Die Brigg {given} {given} sank vor {place}.
Niemand vom {org} kam.
"""

# Common words to write neutral lines with, so that a value can be told by itself in any surroundings.
_COMMON = (
    "I I I I i i a the a of and in to it was that for on are with as his they at be this from have or had by but some what there we can out other were all your when up use how "
    "said an each she which do their time if way about many then them would like so these her long make thing see two has look more day could go come did no most over know than call "
    "og i jeg det at en den til er som på de med han af for ikke der var mig sig men et har om vi min havde ham hun nu over da fra du ud sin dem os op man hans hvor eller hvad skal "
    "och att det är som på för av inte den till med de ett han om var hade jag men sig från vi så kan när år säger hon under också efter eller nu sin där vid mot ska skulle kommer ut får "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum"
).split()
_NOUNS = (
    "Haus Stadt Zeit Tag Jahr Wasser Frage Seite Schule Arbeit Leute Woche Regen Straße Bahn Kirche Hafen Markt Winter Sommer Abend Morgen Kind Mutter Vater Garten Küche "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December English Danish Swedish German"
).split()
_LABELS = (
    "Route Platform Gate Table Page Volume Section Line Room Bus Hall Article Chapter Day Week Level Type Group Size Linje Spor Perron Side Tabel Bind Afsnit Kapitel Uge Hold Sida Tabell Spår Rad Vecka Grupp "
    "Väg Länsväg Riksväg Landstraße Kreisstraße Bundesstraße Hovedvej Landevej Motorvej Road Highway Väg Landstraße Hovedvej "
    "Seite Tabelle Gleis Band Abschnitt Linie Zimmer Artikel Woche Gruppe Halle Stufe Flat Floor Etage Stock"
).split()
_CODED = "no. number case order ref. nr. sag faktura ordre kunde ärende bilaga Vorgang Rechnung Kunde file reader booking invoice læser läsare Leser ticket account konto".split()
_NEUTRAL = [x for x, n in dict(name=8, phone=5, id=2, address=4, email=1, place=5, org=3, num=2, code=3, date=3, given=1, big=3, time=2, counted=13, titled=8).items() for _ in range(n)]
_GIVEN = (
    "Adam Alice Alma Amir Anders Andrea Anna Anne Anton Arthur Asta Astrid Aisha Barbara Beate Benjamin Birgit Bjarne Bo Brigitte Bruno Camilla Carl Carla Caroline Charles Charlotte "
    "Christian Clara Claus Colin Connor Dagmar Daniel Dennis Dieter Dorthe Edith Eleanor Elias Elin Ellen Else Emil Emily Emma Erik Ernst Esther Eva Fatima Felix Finn Frank Freja Frida "
    "Fritz Georg George Gerda Grace Greta Gunnar Gustav Hanna Hans Harold Harry Heidi Helene Helga Henrik Henry Herbert Hilda Hope Hugo Ian Ida Ines Inga Ingrid Irene Isaac Ivan Jack Jakob "
    "James Jan Jane Jens Jette Johan Johanna John Jonas Jörg Julia Jürgen Kai Karen Karl Katrin Kirsten Klara Knud Kurt Lars Laura Lena Leo Lily Linda Liv Lisa Lone Lotte Louis Lucy Ludwig Lukas "
    "Magnus Maja Malin Marcus Margaret Maria Mark Martha Martin Matilda Max Mette Mia Michael Mogens Nadia Nina Noah Nora Ole Olga Oliver Oskar Otto Paul Per Peter Petra Pia Poul Quentin Rachel Ralf "
    "Rasmus Regina Robert Rosa Rose Ruth Samuel Sara Sigrid Simon Sofie Sonja Søren Sten Stefan Stella Storm Susanne Sven Thea Thomas Tina Tom Tove Ulla Ulrich Ursula Vera Victor Viggo Walter Will "
    "Wilhelm Wolf Yusuf Yvonne Zofia Åke Åsa Ömer Øyvind Anna-Lena Hans-Peter Anne-Marie Karl-Heinz Mary-Jane"
).split()
_FAMILY_STARTS = "Ald Bar Berg Birk Brad Bran Dal Dorn Eck Eld Fair Fen Gran Grim Hal Har Hart Hol Horn Jan Kel Kir Krog Lang Lin Lund Mar Mel Mor Nor Oster Pet Quist Ran Rod Sand Schön Sel Skov Stein Strand Svan Thor Tor Ul Vest Wald Wes Win Yar Åkers Øster Özd".split()
_FAMILY_ENDS = "ager bach bauer beck bekk berg berger borough brook burg bury by dahl dal er feld field ford gaard gren hagen ham hansen hauser heim holm holt house höfer ing ington ison kamp kjær ley lin lund man mann mark meier more mose nes ness gård quist rud sen skov son stad stein ström strøm strup thal thorpe toft ton vang wald wick winkel wood worth øe".split()
_PLACE_STARTS = "Al Ask Bel Bram Dun Ebel Fjor Gam Grün Hav Hel Juls Kal Kron Leth Løg Mal Nes Olde Pad Ring Roth Sil Snede Tys Ulle Var Wester Åby Öster".split()
_PLACE_ENDS = "bruk bury by bæk dorf ford hafen havn heim hult inge köping lev minster mouth nau rup sele sted tal ton torp vik wede ø".split()
_ORGS = (
    "Housing Trust|Rowing Club|Parish Council|Chamber of Trade|Farmers' Union|Health Authority|Film Society|Transport Agency|Boligforening|Idrætsforening|Kommune|Bibliotek|Handelsforening|"
    "Idrottsförening|Kommun|Handelskammare|Sparbank|Landkreis|Turnverein|Sparkasse|Stadtwerke|Mieterverein|Energy Group|Savings Bank|Players|Orchestra|Hospital|Museum|Primary School"
).split("|")
_STEMS_EN = "Oak Maple Hazel Cedar Thistle Meadow Spring Market Kings Queens Victoria Albert London Manor Abbey Castle Cross Grange Priory Windsor Clifton Field Brook Hill Green White Long North South East New Lime Ash Holly Ivy Tower Forge Canal Smith Nelson".split()
_WAYS_EN = "Street Road Lane Avenue Close Row Rise Terrace Mews Court Way Drive Gardens Place Crescent Grove Square Walk Hill Parade St Rd Ave Ln Dr".split()
_STEMS_DA = "Ege Bøge Linde Solsikke Rosen Lærke Viol Engelst Syren Fyrre Hasse Råd Torve Vester Øster Sønder Konge Dronning Peters Hans Elme Skov Bakke Eng Sø Havre Rug Hyben".split()
_WAYS_DA = "vej gade stræde allé vænget vangen parken torvet bakken haven toften svinget plads kaj".split()
_STEMS_SV = "Ek Björk Lind Sol Ros Vasa Drottning Kungs Regerings Södra Norr Väster Skol Ängs Berg Bruks Kvarn Strand Järnvägs Tall".split()
_WAYS_SV = "vägen gatan stigen gränd gränden torget backen allén plan".split()
_STEMS_DE = "Linden Eichen Ahorn Goethe Schiller Haupt Berg Wiesen Mozart Ring Schul Rosen Kirsch Markt Post Wald Feld Brunnen Burg Garten Ufer".split()
_WAYS_DE = "weg straße strasse gasse allee str. platz ring ufer damm stieg".split()
_HOSTS = "mail post inbox letter webmail home office club net line".split()
_ENDS = "example example.com example.org example.net test invalid com org net dk se de co.uk eu no info".split()

# Published written forms of phone numbers: 9 stands for any digit, 2 at the start for one from 2 to 9, N for 9.
_PHONES = (
    "2999 9999|29999999|29 99 99 99|29-99-99-99|29.99.99.99|+45 29 99 99 99|+4529999999|0045 29 99 99 99|004529999999|(+45) 29 99 99 99|(+45) 2999 9999|+45 2999 9999|+45-29-99-99-99|+45 29999999|"
    "08-999 99 99|08 999 99 99|070-999 99 99|070 999 99 99|0709-99 99 99|0709999999|031-99 99 99|+46 70 999 99 99|+46 (0)8 999 99 99|+46(0)70 999 99 99|+46-8-999-99-99|0046 70 9999999|070.999.99.99|"
    "030 9999999|0171 9999999|0171/9999999|0171 999 99 99|+4N 171 9999999|+4N-171-9999999|+4N (0)40 99999-99|+4N (0)30 999999|+4N 30 9999999|0711/999999|(089) 9999 999|0221-9999999|004N 30 9999999|040 999 99 99|030/99999 999|"
    "020 7999 9999|07999 999999|07999 999 999|07999999999|+44 7999 999999|+44 (0)161 999 9999|+44 (0)20 7999 9999|0161 999 9999|(01632) 999999|01999 999999|0044 161 999 9999|+44-20-7999-9999|"
    "(299) 299-9999|299-299-9999|299.299.9999|299 299 9999|2992999999|+1 299 299 9999|1-299-299-9999|1.299.299.9999|1 299 299 9999|+1 (299) 299-9999|+1-299-299-9999|"
    "+47 29 99 99 99|+358 40 999 9999|+31 6 99999999|+33 6 99 99 99 99|+48 999 999 999|+41 79 999 99 99|+43 664 9999999|+353 86 999 9999|+354 999 9999"
).split("|")
# Published written forms of national identity numbers: d m y are day, month and year, A a letter.
_IDS = (
    "ddmmyy-9999|ddmmyy-9999|ddmmyy9999|ddmmyy 9999|ddmmyy - 9999|ddmmyy.9999|"
    "yymmdd-9999|yyyymmdd-9999|yyyymmdd9999|yymmdd 9999|yymmdd+9999|yyyymmdd 9999|yymmdd9999|"
    "ddmmyy 99999|ddmmyy99999|ddmmyy-99999|"
    "ddmmyy-999A|ddmmyy - 999A|ddmmyyA999A|ddmmyy+999A|ddmmyy-999a|"
    "99 999 999 999|99999999999|99 ddmmyy A 999|"
    "AA 99 99 99 A|AA999999A|AA-99-99-99-A|aa999999a|AA 999999 A|aa 99 99 99 a|"
    "999-99-9999|999 99 9999|999.99.9999|999-99-9999|"
    "yymmdd99999|9999.99.999|99999999A|756.9999.9999.99|AAAAAA99A99A999A"
).split("|")
_SWAPS = str.maketrans({"æ": "ae", "ø": "oe", "å": "aa", "ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "é": "e", "'": ""})


def invented_names(seed: int = 5, families: int = 700) -> tuple[list[str], list[str], list[str], list[str]]:
    """(given, family, given listed, family listed): made-up people, and those of them a list would hold, not all."""
    rng = random.Random(seed)
    family = sorted({rng.choice(_FAMILY_STARTS) + rng.choice(("", "", "e", "en", "el", "er")) + rng.choice(_FAMILY_ENDS) for _ in range(families)})
    given = sorted(_GIVEN)
    rng.shuffle(given)
    rng.shuffle(family)
    return given, family, given[: len(given) * 9 // 10], family[: len(family) * 3 // 4]


class _Values:
    def __init__(self, given: list[str], family: list[str], seed: int, ordinary: list[str]):
        self.rng = random.Random(seed)
        self.given_names, self.family_names = given, family
        names = {x.lower() for x in given + family}
        self.ordinary = [x for x in ordinary if x.lower() not in names] or _COMMON

    def pick(self, some):
        return some[self.rng.randrange(len(some))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def number(self, n: int) -> str:
        """n digits, the first of them no 0, as numbers of things that were counted have it."""
        return str(self.rng.randrange(1, 10)) + "".join(str(self.rng.randrange(10)) for _ in range(n - 1))

    def digits(self, form: str) -> str:
        """A written form with its 9 drawn, and 2 where it stands first in its group."""
        out = re.sub(r"9", lambda _: str(self.rng.randrange(10)), re.sub(r"(?<!\d)2(?=99)", lambda _: str(self.rng.randrange(2, 9)), form)).replace("N", "9")
        return out.replace(" ", "\xa0") if self.chance(0.1) else out

    def phone(self) -> str:
        out = self.digits(self.pick(_PHONES))
        if self.chance(0.75):
            return out
        # People group digits as they like: those after a country code or a first group, by one separator.
        head, _, rest = out.partition(" ") if out[0] in "+(" else ("", "", out)
        rest = re.sub(r"\D", "", rest)
        if len(rest) < 5:
            return out
        first = self.rng.randrange(2, 6)
        groups, rest = [rest[:first]], rest[first:]
        while rest:
            n = min(len(rest), self.rng.randrange(2, 6))
            n = len(rest) if len(rest) - n == 1 else n
            groups.append(rest[:n])
            rest = rest[n:]
        sep = self.pick((" ", " ", " ", ".", "", "\xa0"))
        joined = sep.join(groups) if self.chance(0.8) else groups[0] + self.pick("/-") + "".join(groups[1:])
        return f"{head} {joined}" if head else joined

    def id(self) -> str:
        form = self.pick(_IDS)
        year = self.rng.randrange(1925, 2016)
        for a, b in (("yyyy", str(year)), ("yy", f"{year % 100:02}"), ("mm", f"{self.rng.randrange(1, 13):02}"), ("dd", f"{self.rng.randrange(1, 29):02}")):
            form = form.replace(a, re.sub("9", "\x00", b))
        form = re.sub("A", lambda _: self.pick("ABCDEFGHJKLMNPRSTUVWXYZ"), form)
        form = re.sub("a(?![bc-z])", lambda _: self.pick("abcdefghjklmnprstuvwxyz"), form)
        out = re.sub("9", lambda _: str(self.rng.randrange(10)), form).replace("\x00", "9")
        return out.replace(" ", "\xa0") if self.chance(0.1) else out

    def first(self) -> str:
        return self.pick(self.given_names)

    def last(self) -> str:
        return self.pick(self.family_names)

    def name(self) -> str:
        first, last = self.first(), self.last()
        if self.chance(0.1):
            last += "-" + self.last()
        middle = ""
        if self.chance(0.22):
            middle = self.pick([self.first() + " ", self.first()[0] + ". ", self.last() + " ", self.pick(("van ", "von ", "de ", "af "))])
        if self.chance(0.1):
            first = first[0] + "."
        if self.chance(0.18):
            out = f"{last}{self.pick((', ', ', ', ' '))}{first}" + (f" {middle.strip()}" if middle and self.chance(0.3) else "")
        else:
            out = f"{first} {middle}{last}"
        case = self.rng.random()
        out = out.upper() if case < 0.1 else out.lower() if case < 0.2 else out
        if case > 0.96:
            out = out.replace(last, last.upper())
        return out.replace(" ", "\xa0") if self.chance(0.08) else out

    def email(self) -> str:
        first, last = (x.lower().translate(_SWAPS) for x in (self.first(), self.last()))
        word = self.pick(_COMMON).translate(_SWAPS)
        user = self.pick((f"{first}.{last}", f"{first}_{last}", f"{first}-{last}", first, last, f"{last}{self.number(2)}", f"{first[0]}{last}", f"{first}+{word}", f"{word}.{last}", f"{first}{self.number(4)}", f"{first}{last}"))
        host = self.pick(_PLACE_STARTS).lower().translate(_SWAPS) + self.pick(_HOSTS)
        if self.chance(0.3):
            host = f"{self.pick(_HOSTS)}{self.pick('.-')}{host}"
        host = f"{host}.{self.pick(_ENDS)}"
        at, dot = "@", "."
        if self.chance(0.4):
            at = self.pick((" (at) ", "(at)", " [at] ", "[at]", " at ", " AT ", "&#64;", " @ ", "@ ", " (a) "))
            dot = self.pick((".", ".", " dot ", " (dot) ", " [dot] ", "(dot)", "[dot]")) if "at" in at.lower() else "."
        out = user + at + host.replace(".", dot)
        case = self.rng.random()
        return out.upper() if case < 0.06 else out.title() if case < 0.1 else out

    def address(self) -> str:
        n = str(self.rng.randrange(1, self.pick((30, 200)))) + (self.pick(("", " ")) * self.chance(0.2) + self.pick("abcdefABCDEF") if self.chance(0.3) else "")
        kind = self.pick((0, 0, 1, 2, 3))
        if kind == 0:
            stem = f"{self.pick(_STEMS_EN)} {self.pick(_STEMS_EN)}" if self.chance(0.35) else self.pick(_STEMS_EN + self.family_names[:60])
            stem = "St " + stem if self.chance(0.04) else stem
            out = f"{n}{', ' if self.chance(0.1) else ' '}{stem} {self.pick(_WAYS_EN)}"
        else:
            stems, ways, names = ((_STEMS_DA, _WAYS_DA, "Vej Allé Gade Plads"), (_STEMS_SV, _WAYS_SV, "Väg Gata Allé Gränd"), (_STEMS_DE, _WAYS_DE, "Weg Straße Platz Allee"))[kind - 1]
            form = self.rng.random()
            if form < 0.62:
                street = self.pick(stems) + self.pick(("", "", "s")) + self.pick(ways)
            elif form < 0.78:
                street = self.pick(self.family_names).rstrip("s") + self.pick(("", "s")) + self.pick(ways)
            elif form < 0.9:
                street = f"{self.pick(('Gamle', 'Store', 'Lille', 'Nørre', 'Gamla', 'Stora', 'Norra', 'Alte', 'Neue', 'Obere'))} {self.pick(stems)}{self.pick(ways)}"
            else:
                street = f"{self.pick(self.given_names)} {self.pick(self.family_names)}s {self.pick(names.split())}" if self.chance(0.5) else f"{self.pick(stems)}er {self.pick(names.split())}"
            gap = self.pick((" nr. ", " nr ", ", ", " Nr. ", " no. ")) if self.chance(0.2) else "\xa0" if self.chance(0.12) else " "
            out = f"{street}{gap}{n}"
        case = self.rng.random()
        return out.upper() if case < 0.08 else out.lower() if case < 0.16 else out

    def code(self) -> str:
        year = self.rng.randrange(1990, 2031)
        return self.pick(
            (
                f"{year}-{self.number(6)}", f"{year}-{self.number(4)}-{self.number(3)}", f"{year}/{self.number(4)}", f"{year}-{self.number(4)}-{self.number(2)}", f"{year}-{self.number(4)}", f"{self.number(4)} {self.number(4)}", self.number(8), self.number(6), self.number(5),
                f"{self.pick('ABCDEFGHKLM')}{self.number(5)}", f"{self.pick(('RF', 'KB', 'INV', 'TK', 'LX'))}-{self.number(6)}", f"{year}{self.number(4)}", f"{year}/{self.number(4)}-{self.number(3)}",
                f"978-{self.number(1)}-{self.number(2)}-{self.number(6)}-{self.number(1)}", f"{self.number(2)}/{self.number(4)}", f"{year}-{self.number(4)}-{self.pick(_COMMON)}", f"{self.number(3)}-{self.number(6)}",
            )
        )

    def value(self, slot: str) -> str:
        r = self.rng
        if slot == "place":
            return self.pick(_PLACE_STARTS) + self.pick(("", "", "e", "er")) + self.pick(_PLACE_ENDS) + (f" {self.pick(('Green', 'Point', 'Common', 'Heath', 'Mose', 'Sund', 'Hede', 'Bruk'))}" if self.chance(0.25) else "")
        if slot == "org":
            return f"{self.value('place')} {self.pick(_ORGS)}" if self.chance(0.6) else f"{self.pick(_STEMS_EN)} {self.pick(_ORGS)}"
        if slot == "word":
            return self.pick(_COMMON)
        if slot == "given":
            return self.first()
        if slot == "num":
            return str(r.randrange(1, self.pick((20, 100, 2000))))
        if slot == "year":
            return str(r.randrange(1850, 2031))
        if slot == "big":
            return f"{r.randrange(1, 999)}{self.pick('., ')}{self.number(3)}" + (f"{self.pick('.,')}{self.number(3)}" if self.chance(0.3) else "")
        if slot == "time":
            return f"{r.randrange(24)}{self.pick(':.')}{r.randrange(60):02}"
        if slot == "money":
            return self.pick(("", "£", "€", "$")) + f"{r.randrange(1, 999)}{self.pick('.,')}{self.number(2)}" + self.pick(("", " kr.", " kr", " €", " pounds"))
        if slot == "date":
            d, m, y = r.randrange(1, 29), r.randrange(1, 13), r.randrange(1990, 2031)
            return self.pick((f"{d}.{m}.{y}", f"{d:02}-{m:02}-{y}", f"{y}-{m:02}-{d:02}", f"{d}/{m} {y}", f"{d} May {y}", f"{d}. maj {y}", f"{m:02}/{d:02}/{y % 100:02}"))
        return getattr(self, slot)()

    def plain_word(self) -> str:
        word = self.pick(_COMMON) if self.chance(0.4) else self.pick(self.ordinary)
        return word if not self.chance(0.1) else self.pick(_NOUNS) if self.chance(0.3) else self.pick(self.ordinary).capitalize()

    def counted(self) -> str:
        """A number beside a word, as streets and houses have them too."""
        n = str(self.rng.randrange(1, self.pick((20, 100, 2000))))
        word = self.pick(self.ordinary)
        return self.pick((f"{n} {word}", f"{n} {word} {self.pick(self.ordinary)}", f"{n} {word.capitalize()}", f"{self.pick(_LABELS)} {n}", f"{self.pick(_LABELS)} {n}", f"{self.pick(_LABELS)} {n}", f"{self.pick(_LABELS).lower()} {n}{self.pick('abc')}", f"{word.capitalize()} {n}", f"{word.capitalize()} {n}", f"{word.capitalize()} {n}", f"{self.pick(_NOUNS)} {n}", f"{n} {self.pick(_NOUNS)}", f"{n}. {self.pick(_NOUNS)} {n}", f"{word} {n}", f"{word} {n}", f"{n} {word}", f"{n} %", f"{n}-{word}"))

    def titled(self) -> str:
        """Capitalised words that are no person."""
        words = [self.pick(self.ordinary).capitalize() for _ in range(self.rng.randrange(1, 4))]
        return " ".join(words + [self.pick(_ORGS)] * self.chance(0.4))

    def neutral(self) -> str:
        """A line of ordinary words around a value or a thing that looks like one."""
        words = [self.plain_word() for _ in range(self.rng.randrange(3, 14))]
        for _ in range(self.rng.randrange(1, 5)):
            slot = self.pick(_NEUTRAL)
            at = self.rng.randrange(len(words) + 1)
            if slot == "code":
                words[at:at] = [self.pick(_CODED), "{code}"]
            elif slot in ("counted", "titled"):
                words.insert(at, getattr(self, slot)())
            elif slot:
                words.insert(at, f"{{{slot}}}")
        words[0] = words[0].capitalize() if self.chance(0.8) and "{" not in words[0] else words[0]
        if len(words) > 6 and self.chance(0.5):
            at = self.rng.randrange(2, len(words) - 2)
            words[at] += self.pick((",", ",", ",", ";", ":", " –"))
        return " ".join(words) + self.pick((".", ".", ".", "!", "?", "", ":"))


def wordings(held: bool) -> tuple[list[str], list[str]]:
    """Marked and plain wordings: every third, set aside, with `held`, else the others."""
    return tuple([x.replace("\\n", "\n") for i, x in enumerate(dict.fromkeys(t.strip().split("\n"))) if (i % 3 == 1) == held] for t in (MARKED, PLAIN))


def wording_words() -> frozenset[str]:
    """The words, in lower case, of the wordings to train on and of the common words."""
    text = re.sub(r"\{\w+\}", " ", " ".join(x for some in wordings(False) for x in some))
    return frozenset(x.lower() for x in re.findall(r"[^\W\d_]+", text)) | frozenset(_COMMON)


def filled(rounds: int = 18, seed: int = 10, held: bool = False, neutral: float = 2.0, ordinary: list[str] = _COMMON) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """[(text, [(start, end, kind)])]: the wordings with values, `rounds` times over, in threes.

    With `held` those set aside, else those to train on, each time with `neutral` times as many neutral
    lines among them, of common and of `ordinary` words.
    """
    given, family, _, _ = invented_names()
    v = _Values(given, family, seed, ordinary)
    marked, plain = wordings(held)
    out = []
    for _ in range(rounds):
        sentences = marked + plain
        sentences += [v.neutral() for _ in range(int(neutral * len(sentences)))]
        v.rng.shuffle(sentences)
        for at in range(0, len(sentences), 3):
            text, spans = "", []
            for s in sentences[at : at + 3]:
                if v.chance(0.1) and "\n" not in s and s[0] != "<":
                    s = v.pick(("<p>", "\ufeff", "<div>", "<b>")) + s + v.pick(("</p>", "", "</b>", "\n</div>"))
                text += v.pick(("", " ", "\n", "\n\n")) if not text else v.pick((" ", " ", " ", "\n", "\n\n", " \n", "\r\n"))
                for part in re.split(r"(\{\w+\})", s):
                    if part.startswith("{"):
                        slot = part[1:-1]
                        value = v.value(slot)
                        kind = "idnumber" if slot == "id" else slot
                        if kind in KINDS:
                            spans.append((len(text), len(text) + len(value), kind))
                        text += value
                    else:
                        text += part
            out.append((text, spans))
    return out
