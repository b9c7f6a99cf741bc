"""The texts that the reference SQL expects, stated apart from the package."""

# Prompt and message wording.
TEMPLATES = {'outline': 'Plan a complete book.\n'
            '\n'
            'Title: {title}\n'
            '\n'
            'What the editor asks for:\n'
            '{notes}\n'
            '\n'
            "Answer in Markdown. Open with an introduction, then 8 to 12 headings of the form '## Chapter N: Title', "
            'each with a short description, then a conclusion.',
 'outline_revision': "Improve the outline of the book '{title}'.\n"
                     '\n'
                     'Current outline:\n'
                     '{outline}\n'
                     '\n'
                     "The editor's remarks:\n"
                     '{feedback}\n'
                     '\n'
                     'Keep the Markdown structure and answer every remark.',
 'chapter': "Write one chapter of the book '{title}'.\n"
            '\n'
            'Outline of the book:\n'
            '{outline}\n'
            '\n'
            '{context}\n'
            '\n'
            'Chapter {number}: {chapter_title}\n'
            '{notes_section}\n'
            'Continue from the earlier chapters, follow the outline, explain with examples, keep the tone of the '
            'book, and aim for 2000 to 3000 words.',
 'notes_section': "\nThe editor's notes for this chapter:\n{notes}\n",
 'summary': 'Sum up this chapter in 3 to 5 sentences, with its main points and conclusions.\n'
            '\n'
            'Book: {title}\n'
            'Chapter {number}: {chapter_title}\n'
            '\n'
            '{content}',
 'chapter_revision': "Revise a chapter of the book '{title}'.\n"
                     '\n'
                     'Chapter {number}: {chapter_title}\n'
                     '\n'
                     'Current text:\n'
                     '{content}\n'
                     '\n'
                     "The editor's remarks:\n"
                     '{feedback}\n'
                     '\n'
                     'Answer every remark and keep the style of the rest.'}

MESSAGES = {'outline_ready': 'The outline of "{title}" is ready for review.\n'
                  '\n'
                  '- Put remarks into notes_on_outline_after.\n'
                  '- Set status_outline_notes to no_notes_needed to start the chapters, or to yes to take more '
                  'time.\n'
                  '\n'
                  'Book ID: {book_id}',
 'waiting_chapter_notes': 'Chapter {number} of "{title}" waits for review.\n'
                          '\n'
                          '- Put remarks into its notes.\n'
                          '- Set its notes_status to no_notes_needed to approve it.\n'
                          '\n'
                          'Book ID: {book_id}',
 'chapter_ready': 'Chapter {number} of "{title}" has been written and can be reviewed.\n\nBook ID: {book_id}',
 'final_draft_ready': '"{title}" has been compiled.\n\nFiles:\n{paths}\n\nBook ID: {book_id}',
 'error_pause': 'Production of this book has stopped:\n\n{error}\n\nResolve it to continue.\n\nBook ID: {book_id}',
 'book_completed': '"{title}" is complete: all chapters are reviewed and the final draft is compiled.\n'
                   '\n'
                   'Book ID: {book_id}'}
