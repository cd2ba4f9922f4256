"""The small labelled table that the conditional random field is trained on.

Fixed values: sentences in which personal data stands in brackets with its kind; the rest is none.
"""

SENTENCES = """
please call {phone|555-123-4567} before noon
my number is {phone|(555) 123-4567} thanks
tel {phone|030 1234567} or write
phone: {phone|0171 2345678} at work
tel. {phone|555 987 6543} ask for anna
fax {phone|555.222.3344} only
reach me on {phone|(212) 555 0199} today
mobile {phone|07700 900123} any time
ring {phone|1-800-555-0142} for help
kontakt {phone|0221/445566} am abend
appelez le {phone|01 23 45 67 89} demain
llame al {phone|91 234 56 78} por favor
téléphone {phone|06.12.34.56.78} le soir
telefon {phone|0049 30 123456} tagsüber
call {phone|(020) 7946 0123} now
call {phone|+1 (555) 222-3344} 4524132264652876 then
fax {phone|+1 (412) 555-7788} 4785380592391139 too
tel {phone|(412) 555-7788} 2123465659789240 done
and {phone|+1 (310) 555-4510} 8646308210557563 here
write to {email|jane (at) mail (dot) org} soon
contact {email|john.smith (at) example (dot) com} for more
e-mail {email|info [at] shop [dot] net} please
send it to {email|bob {at} post {dot} de} today
mail {email|sales(at)firm(dot)com} with questions
reply to {email|anna.b [at] uni-stadt.de} by monday
my address is {email|tom@localhost} inside
write {email|root@server} if it fails
card {card|4111.1111.1111.1111} expires soon
visa {card|4111/1111/1111/1111} was charged
credit card {card|5500_0000_0000_0004} on file
card number {card|3400.000000.00009} please
pay with {card|4012.8888.8888.1881} now
connect to {ip|2001:db8:0:1:1:1:1:1} over tls
host {ip|fe80::1ff:fe23:4567:890a} is down
the server {ip|2001:db8::8a2e:370:7334} answered
from {ip|192[.]168[.]0[.]12} came traffic
block {ip|10[.]1[.]2[.]3} at once
on 2024-01-05 we met again
at 12:30 the train left
the price was $12.50 each
it costs 1,234,567 in all
about 1.234.567 people came
version 1.2.3 is out
see section 4.1.2 for more
pages 12-15 and 20-24 matter
in 1999 and 2004 it rained
order 1234567890123456 was sent
number 4785380592391139 is no card
the id 2123465659789240 is free
token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" was found
hash 6df57b16f87eabefefcab67b433efd90636bb6bd matches
commit 9f3c2a1 fixed it
isbn 978-3-16-148410-0 in print
room 101 on floor 3
100 people and 25 dogs
50% of 80 is 40
the 2nd and 3rd of 10 items
route 66 and highway 101
born 05.11.1972 in town
on 12/24/2023 they left
10:15:42 was the time
scores of 3-2 and 4-1
chapter 7: the end
x1 and y2 are names
a4 paper, 80g
mp3 and h264 files
1 2 3 4 5 6 7 8 9
2019 2020 2021 2022
from 100 to 200 to 300
zip 10115 berlin
cost 12 34 56 in parts
temperature -12.5 to 14.8 degrees
{phone|555-867-5309} is her number
she said (1) first and (2) second
covid-19 and sars-2
v2.0.1-beta is here
3.14159 and 2.71828
account 00012345 closed
serial 88-1234-5678-99 stamped
invoice 2023-000123 is due
look @ this and @ that
@name said hello to @other
meet me at noon dot or not
the (at) sign is odd
write {email|jane [AT] mail [DOT] org} soon
{email|jane (At) mail (Dot) org} is hers
send {email|ANNA [AT] POST [DOT] DE} the file
mail {email|jane at mail dot org} for more
ask {email|bob dot smith at post dot de} today
contact {email|INFO AT SHOP DOT NET} now
reach {email|tom at firm dot co dot uk} by noon
her address {email|eva at uni dot edu} is new
write {email|sales(AT)firm(DOT)com} instead
we wait at noon dot dot dot and go
look at every dot on the wall
start at one dot then stop
meet at nine dot we said
"""
