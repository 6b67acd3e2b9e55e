"""Expected facts of every Python fragment, checked by hand.

Columns: fragment, ordinal, kind, line and last line within the fragment, name,
function, literal value, kind of the first argument, shell switch, names under
each positional argument (arguments split by ``;``).  ``-`` stands for null.
"""

from __future__ import annotations

GOLDEN_FACTS = """\
0|0|assign|1|1|api_key|-|QWERTYuiop1234567890ABCD|-|-|-
0|1|assign|2|2|other_key|-|-|-|-|-
0|2|call|2|2|-|load|-|other|False|
1|0|assign|2|2|API_SECRET|-|abcdEFGH/+ijkl0123456789zz|-|-|-
1|1|assign|3|3|api_secret|-|has-dash-and_underscore_so_no_hit|-|-|-
4|0|assign|1|1|password|-|correct horse|-|-|-
4|1|assign|2|2|password|-|****************|-|-|-
4|2|assign|3|3|password|-|<fill in here>|-|-|-
4|3|assign|4|4|PASSWORD|-|<Kept Template>|-|-|-
5|0|assign|1|1|db_pwd|-|short|-|-|-
5|1|assign|2|2|passwd|-|longenough1|-|-|-
5|2|assign|3|3|secret_value|-|changeme|-|-|-
8|0|assign|1|1|auth_token|-|prod-token-value|-|-|-
8|1|assign|3|3|private_key|-|-|-|-|-
8|2|assign|4|4|api_key|-|abc|-|-|-
8|3|assign|5|5|api_key|-||-|-|-
10|0|call|1|1|-|cursor.execute|-|add|False|user_id
11|0|call|1|1|-|db.execute|-|other|False|format,user_id
11|1|call|2|2|-|cursor.execute|-|other|False|;user_id
11|2|call|1|1|-|format|-|other|False|user_id
12|0|call|1|1|-|cursor.execute|-|fstring|False|sid
12|1|call|2|2|-|run_query|-|fstring|False|name
13|0|call|1|1|-|query|-|add|False|base,suffix
13|1|call|2|2|-|session.execute|-|other|False|
13|2|call|3|3|-|self.db.conn.executemany|-|add|False|sql,tail;rows
14|0|call|1|5|-|cursor.execute|-|add|False|value
18|0|call|2|2|-|os.system|-|add|False|path
18|1|call|3|3|-|subprocess.call|-|other|False|
18|2|call|4|4|-|subprocess.run|-|other|True|cmd
19|0|assign|1|1|result|-|-|-|-|-
19|1|assign|2|2|value|-|-|-|-|-
19|2|call|1|1|-|eval|-|other|False|expression
19|3|call|2|2|-|literal_eval|-|other|False|expression
19|4|call|3|3|-|exec|-|other|False|code
20|0|assign|2|2|obj|-|-|-|-|-
20|1|call|2|2|-|pickle.loads|-|other|False|blob
20|2|assign|4|4|other|-|-|-|-|-
20|3|call|3|3|-|open|-|other|False|name
20|4|call|4|4|-|pickle.load|-|other|False|fh
21|0|assign|2|2|n|-|-|-|-|-
21|1|assign|3|3|x|-|-|-|-|-
21|2|assign|4|4|c|-|-|-|-|-
21|3|call|2|2|-|random.randint|-|other|False|;
21|4|call|3|3|-|random.random|-|-|False|
21|5|call|4|4|-|random.choice|-|other|False|items
21|6|call|5|5|-|random.shuffle|-|other|False|items
22|0|assign|1|1|fh|-|-|-|-|-
22|1|assign|2|2|fh2|-|-|-|-|-
22|2|call|1|1|-|open|-|add|False|base,name
22|3|call|2|2|-|open|-|other|False|name
22|4|call|3|3|-|file|-|add|False|b
24|0|assign|2|2|h|-|-|-|-|-
24|1|assign|3|3|g|-|-|-|-|-
24|2|assign|4|4|k|-|-|-|-|-
24|3|call|2|2|-|hexdigest|-|-|False|
24|4|call|3|3|-|hashlib.sha1|-|other|False|data
24|5|call|4|4|-|hashlib.sha256|-|other|False|data
24|6|call|2|2|-|hashlib.md5|-|other|False|data
25|0|assign|1|1|c|-|-|-|-|-
25|1|assign|2|2|d|-|-|-|-|-
25|2|assign|3|3|e|-|-|-|-|-
25|3|assign|4|4|f|-|-|-|-|-
25|4|call|1|1|-|DES.new|-|other|False|key
25|5|call|2|2|-|Blowfish.new|-|other|False|key;mode
25|6|call|3|3|-|AES.new|-|other|False|key
25|7|call|4|4|-|rc4.new|-|other|False|key
26|0|call|1|1|-|app.route|-|other|False|
26|1|call|5|5|-|app.route|-|other|False|
27|0|assign|3|3|ssl_verify|-|-|-|-|-
27|1|assign|4|4|verify|-|-|-|-|-
27|2|call|1|1|-|requests.get|-|other|False|url
28|0|assign|3|3|host|-|127.0.0.1|-|-|-
28|1|call|1|1|-|app.run|-|-|False|
32|0|call|1|1|-|logger.info|-|other|False|
32|1|call|2|2|-|print|-|other|False|
32|2|call|3|3|-|send|-|other|False|
33|0|call|1|1|-|print|-|other|False|
33|1|call|2|2|-|print|-|fstring|False|
33|2|call|3|3|-|log|-|other|False|
35|0|call|1|1|-|logger.info|-|other|False|email,user
35|1|call|2|2|-|logger.debug|-|other|False|;customer,phone
35|2|call|3|3|-|log.warn|-|other|False|order,total
35|3|call|4|4|-|print|-|other|False|address
36|0|assign|2|2|ssn|-|-|-|-|-
36|1|assign|3|3|credit_card|-|-|-|-|-
36|2|assign|4|4|name|-|-|-|-|-
36|3|call|2|2|-|models.CharField|-|-|False|
36|4|call|3|3|-|models.TextField|-|-|False|
36|5|call|4|4|-|models.CharField|-|-|False|
37|0|assign|1|1|ftp|-|-|-|-|-
37|1|assign|2|2|url|-|sftp://host/file|-|-|-
37|2|assign|3|3|src|-|ftp://host/file|-|-|-
37|3|call|1|1|-|ftplib.FTP|-|other|False|
38|0|call|2|2|-|store|-|other|False|form
38|1|call|3|3|-|process|-|other|False|user_data
39|0|assign|3|3|catalog|-|-|-|-|-
39|1|call|1|1|-|print|-|other|False|
39|2|call|2|2|-|logger.info|-|fstring|False|diagnosis,patient
40|0|assign|2|2|diagnosis|-|-|-|-|-
40|1|assign|3|3|medical_record|-|-|-|-|-
40|2|assign|4|4|health_data|-|-|-|-|-
40|3|call|2|2|-|models.TextField|-|-|False|
40|4|call|3|3|-|models.TextField|-|-|False|
40|5|call|4|4|-|EncryptedField|-|-|False|
41|0|assign|1|1|cvv|-|-|-|-|-
41|1|assign|2|2|cvc|-|-|-|-|-
41|2|assign|3|4|security_code|-|-|-|-|-
42|0|assign|2|2|card_number|-|-|-|-|-
42|1|assign|3|3|cardholder|-|-|-|-|-
42|2|assign|4|4|pan|-|-|-|-|-
42|3|call|2|2|-|models.CharField|-|-|False|
42|4|call|3|3|-|models.CharField|-|-|False|
42|5|call|4|4|-|EncryptedCharField|-|-|False|
43|0|call|2|2|-|send|-|other|False|user_data
44|0|assign|1|1|DATABASE_URL|-|postgres://u?password=hunter2&x=1|-|-|-
44|1|assign|2|2|db_connection|-|server=a;user=b|-|-|-
45|0|assign|1|1|date_of_birth|-|-|-|-|-
45|1|assign|2|2|full_address|-|-|-|-|-
45|2|assign|3|3|social_security|-|-|-|-|-
45|3|call|1|1|-|form.get|-|other|False|
45|4|call|2|2|-|form.get|-|other|False|
45|5|call|3|3|-|aes_encrypt|-|other|False|v
46|0|assign|1|1|graphic|-|-|-|-|-
46|1|assign|2|2|user_password|-|-|-|-|-
46|2|assign|3|3|credit_card_token|-|-|-|-|-
46|3|assign|4|6|ssn_cipher|-|-|-|-|-
46|4|call|1|1|-|draw|-|-|False|
46|5|call|2|2|-|get|-|-|False|
46|6|call|3|3|-|secure_vault.get|-|-|False|
46|7|call|4|6|-|cipher.run|-|other|False|value
47|0|call|1|1|-|math.log|-|other|False|email
47|1|call|2|2|-|login|-|other|False|password
47|2|call|3|3|-|print|-|other|False|a;b,ssn;c,email
47|3|call|4|4|-|console.write|-|other|False|phone_number,x
47|4|call|5|5|-|logger.info|-|other|False|
56|0|assign|1|1|conn|-|-|-|-|-
56|1|assign|2|2|ROLE|-|-|-|-|-
56|2|assign|3|3|other|-|-|-|-|-
56|3|call|1|1|-|connect|-|-|False|
56|4|call|3|3|-|connect|-|-|False|
61|0|call|1|1|-|app.get|-|other|False|
61|1|call|5|5|-|router.delete|-|other|False|
61|2|call|3|3|-|repo.get_by_id|-|other|False|user_id
61|3|call|7|7|-|session.get|-|other|False|order;order_id
64|0|call|1|1|-|print|-|add|False|eval,source
64|1|call|2|2|-|logger.info|-|other|False|
64|2|call|1|1|-|eval|-|other|False|source
65|0|call|1|1|-|cursor.execute|-|add|False|email,user
65|1|call|2|2|-|logger.info|-|add|False|credit_card,str,user
65|2|call|2|2|-|str|-|other|False|credit_card,user
67|0|assign|2|2|token|-|live-0123456789|-|-|-
67|1|assign|3|3|x|-|p@ssw0rd!|-|-|-
67|2|assign|3|3|y|-|p@ssw0rd!|-|-|-
67|3|assign|3|3|db_password|-|p@ssw0rd!|-|-|-
67|4|assign|6|6|client_secret|-|-|-|-|-
71|0|assign|1|1|value|-|-|-|-|-
71|1|assign|2|2|result|-|-|-|-|-
71|2|call|1|1|-|compute|-|-|False|
"""


def golden_rows() -> list[list[str | None]]:
    rows = [line.split("|") for line in GOLDEN_FACTS.splitlines()]
    return [[None if cell == "-" else cell for cell in row] for row in rows]
